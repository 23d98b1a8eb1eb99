"""Token ids of texts, in Spark tasks.

The ids are those that the library tokenizers gives with ``byte_bpe_50k.json`` and
add_special_tokens=False; a text that holds the string of the special token gets its id. They are
made from the same vocabulary's ranks by the library tiktoken, which is several times faster and
tested to give equal ids. The folder of the vocabulary files is a parameter; its files are on every
machine, as the library is.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The special token's string and id, and the number of ids.
SPECIAL = {"<|endoftext|>": 50256}
VOCABULARY = 50257
#: The end of a document in token files: a 16-bit number that is no id, so that no text has it.
END_MARK = 0xFFFF


def tokenizer_dir() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).parent)


@lru_cache(maxsize=2)
def encoding(folder: str):
    import public_tokenizers
    import tiktoken

    lines = (Path(folder) / "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_rows(docs: DataFrame, end: int, folder: str | None = None) -> DataFrame:
    """(doc_id, ids): ids is the text's ids and then ``end``, as little-endian 16-bit numbers.
    Null text is empty. One row per row of docs, in the order of the scan."""
    folder = folder or tokenizer_dir()

    def run(batches):
        coder = encoding(folder)

        def encode(text: str) -> list[int]:
            if any(s in text for s in SPECIAL):
                return coder.encode(text, allowed_special="all")
            return coder.encode_ordinary(text)

        for batch in batches:
            ids = [np.array([*encode(t.as_py() or ""), end], "<u2").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")
