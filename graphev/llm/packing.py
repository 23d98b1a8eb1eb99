"""Lexical retrieval packing.

Documents become token ids and one end id. Tasks cut their part of the documents into shards of
about ``SHARD_TOKENS`` ids; each shard gets an inverted index over token ids with BM25 weights,
whose document frequencies and mean length come from all documents. A seed document opens a
window; all its distinct ids look up the shard's best unused neighbours, which follow the seed,
best first. No id and no posting is left out: a shard's most frequent ids are columns of a matrix,
whose products with the seeds are their sums of weights, and all other ids have lists of postings.
The end mark, which all documents share, weighs nothing. A document that does not fit is cut, fills its window to the last id and
opens the next one as its seed, so every window but a task's last is full. Where the index knows
no unused neighbour, the next document in the order of the scan follows.

Every id of every document lies in exactly one piece. Null text is empty: just the end id.
Repeated rows and null doc_ids are documents of their own. A document longer than a shard is a
shard. Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphev.llm.common import new_dir, table
from graphev.llm.tokens import VOCABULARY, token_rows

WINDOW, END, SHARD_TOKENS = 2048, 1, 1 << 22
K1, B = 1.2, 0.75
#: Cells of a shard's matrix and of its kept products (16 and 64 MB), its columns at most, documents
#: whose products are made together, and how many neighbours are taken at a time. They bound memory
#: and set the speed; the neighbours do not depend on them.
CELLS, KEPT_CELLS, COLUMNS, TOGETHER, AT_A_TIME = 1 << 22, 1 << 24, 2048, 256, 64
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def term_counts(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their counts; last is scratch space for the vocabulary."""
    at = np.arange(len(ids))
    last[ids] = at
    where = last[ids]
    one = np.flatnonzero(where == at)
    return ids[one], np.bincount(where, minlength=len(ids))[one]


def corpus_stats(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, number of documents and mean length, over all rows. One
    number for each id of the vocabulary comes to the driver, whatever the size of the corpus."""

    def run(batches):
        df, last, docs, total = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                df[term_counts(ids, last)[0]] += 1
                docs, total = docs + 1, total + len(ids)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*seen, -1, -2], pa.int64()), pa.array([*df[seen], docs, total], pa.int64())], names=["id", "n"])

    sums = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    got = {r["id"]: r["n"] for r in sums}
    df = np.zeros(VOCABULARY, np.int64)
    for k, v in got.items():
        if k >= 0:
            df[k] = v
    docs = got.get(-1, 0)
    return df, docs, got.get(-2, 0) / max(docs, 1)


class Shard:
    """The inverted index of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        last, n = np.zeros(VOCABULARY, np.int64), len(docs)
        self.queries, weights = [], []
        for ids in docs:
            t, tf = term_counts(ids, last)
            self.queries.append(t)
            weights.append((idf[t] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))).astype(np.float32))
        terms, weights = np.concatenate(self.queries), np.concatenate(weights)
        of = np.repeat(np.arange(n, dtype=np.int32), [len(q) for q in self.queries])
        df = np.bincount(terms, minlength=VOCABULARY)
        width = max(1, min(COLUMNS, CELLS // n))
        frequent = np.argpartition(-df, width)[:width]
        self.column = np.full(VOCABULARY, -1, np.int32)
        self.column[frequent] = np.arange(width, dtype=np.int32)
        column = self.column[terms]
        wide = column >= 0
        self.matrix = np.zeros((n, width), np.float32)
        self.matrix[of[wide], column[wide]] = weights[wide]
        terms, weights, of = terms[~wide], weights[~wide], of[~wide]
        order = np.argsort(terms, kind="stable")
        self.weights, self.docs = weights[order], of[order]
        self.at = np.searchsorted(terms[order], np.arange(VOCABULARY + 1))
        self.together = TOGETHER if n * n <= KEPT_CELLS else 1
        self.products: dict[int, np.ndarray] = {}
        self.unused = np.ones(n, bool)
        self.next = 0

    def sums(self, d: int) -> np.ndarray:
        """The sums of every document's weights over d's frequent ids."""
        group, row = divmod(d, self.together)
        if (made := self.products.get(group)) is None:
            first = group * self.together
            asked = np.zeros((min(self.together, len(self.queries) - first), self.matrix.shape[1]), np.float32)
            for i in range(len(asked)):
                columns = self.column[self.queries[first + i]]
                asked[i, columns[columns >= 0]] = 1
            made = asked @ self.matrix.T
            if self.together > 1:
                self.products[group] = made
        return made[row]

    def scores(self, d: int) -> np.ndarray:
        """The BM25 score of every document for all distinct ids of d."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.queries[d] if self.column[t] < 0]
        if not spans:
            return self.sums(d).copy()
        found, weights = np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans])
        return self.sums(d) + np.bincount(found, weights, len(self.queries))

    def neighbours(self, d: int) -> list[int]:
        """The best unused documents that share an id with d, the worst first. Empty if none is left."""
        scores = self.scores(d)
        scores[~self.unused] = 0
        best = np.argpartition(-scores, AT_A_TIME)[:AT_A_TIME] if len(scores) > AT_A_TIME else np.arange(len(scores))
        best = best[scores[best] > 0]
        return best[np.lexsort((-best, scores[best]))].tolist()

    def following(self) -> int | None:
        while self.next < len(self.unused) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.unused) else None


class Windows:
    """The windows that a task fills, and the pieces in them."""

    def __init__(self, first_id: int, window: int):
        self.id, self.used, self.window = first_id, 0, window
        self.pieces: list[tuple] = []

    def place(self, doc_id, ids: np.ndarray) -> bool:
        """Adds a document; true if it opened a window that still has room."""
        done, opened = 0, self.used == 0
        wide = ids.astype("<u4")
        while done < len(ids):
            n = min(self.window - self.used, len(ids) - done)
            self.pieces.append((doc_id, done, n, zlib.crc32(wide[done : done + n]), len(ids), self.id, self.used))
            done, self.used = done + n, self.used + n
            if self.used == self.window:
                self.id, self.used, opened = self.id + 1, 0, True
        return opened and self.used > 0

    def fill(self, doc_ids: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        shard = Shard(docs, idf, mean)
        seed, queue = None, []
        while True:
            if not queue and seed is not None:
                queue = shard.neighbours(seed)
            d = queue.pop() if queue else shard.following()
            if d is None:
                return
            shard.unused[d] = False
            if self.place(doc_ids[d], docs[d]):
                seed, queue = d, []
            elif self.used == 0:
                seed, queue = None, []


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, tokens_at: str | None = None) -> DataFrame:
    """docs: doc_id, text. One row per piece: doc_id and PIECE. The tokens are kept in a folder
    of their own in the shared one, as they are read twice."""
    spark = docs.sparkSession
    tokens_at = tokens_at or new_dir(spark, "packing")
    kind = dict(docs.dtypes)["doc_id"]
    token_rows(docs, END).write.parquet(tokens_at)
    rows = spark.read.schema(f"doc_id {kind}, ids binary").parquet(tokens_at)
    df, n, mean = corpus_stats(rows)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    idf[END] = 0
    known = spark.sparkContext.broadcast((idf, max(mean, 1.0)))

    def run(batches):
        idf, mean = known.value
        out = Windows(TaskContext.get().partitionId() << 32, window)
        doc_ids, ids, size = [], [], 0

        def pieces():
            cols = list(zip(*out.pieces)) or [()] * 7
            out.pieces = []
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", *NAMES])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, raw in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                ids.append(np.frombuffer(raw.as_py(), "<u2"))
                size += len(ids[-1])
                if size >= shard_tokens:
                    out.fill(doc_ids, ids, idf, mean)
                    doc_ids, ids, size = [], [], 0
                    yield from pieces()
        if ids:
            out.fill(doc_ids, ids, idf, mean)
            yield from pieces()

    return rows.mapInArrow(run, f"doc_id {kind}, {PIECE}")


def op10_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
