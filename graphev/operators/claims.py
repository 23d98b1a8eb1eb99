"""Text gates over claims (subject, object, relation, sentence), as ordered tables of rules.

A rule is a test that gives the words it found or null, and a verdict; the first rule in the order
whose test finds something decides. Tests are columns, so a table of rules is one projection: no
join, no shuffle, and constant patterns are compiled once. Vocabularies are parameters; the ones here
are the defaults.

Quantities need the places of matches for their contexts, which no built-in function gives: they are
found in one Arrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: stems, cues and word forms of the relations ------------------------------------
KEYWORDS = {
    "inhibits": ["inhib", "antagon", "block", "suppress", "downregulat", "abrogat", "potency", "ic50", "deplet", "silenc", "knockdown"],
    "indirect_inhibitor": ["inhib", "block", "suppress", "downregulat", "reduc", "indirect", "deplet", "attenuat"],
    "activates": ["activat", "agonist", "induc", "upregulat", "stimulat", "potentiat", "promot", "trigger"],
    "associated_with": ["associat", "linked", "implicat", "correlat", "overexpress", "mutation", "polymorphism", "prognostic", "biomarker"],
    "treats": ["treat", "therap", "clinical trial", "effica", "approv", "indicat", "respon", "survival"],
    "driver_of": ["driver", "drives", "caus", "oncogen", "tumorigen", "pathogenesis", "promot"],
    "binds": ["bind", "affinity", "complex with", "engage", "dock", "kd", "ki", "co-crystal"],
    "interacts": ["interact", "binds", "complex", "physical", "co-immunoprecipitat"],
    "phosphorylates": ["phosphorylat"],
    "synergizes_with": ["synerg", "combin", "potentiat", "additive", "co-treat"],
}
UP_CUES = ["increas", "upregulat", "induct", "enhanc", "activat", "promot", "elevat"]
DOWN_CUES = ["decreas", "reduc", "loss of", "abrogat", "suppress", "downregulat", "blockade", "inhibit", "attenuat"]
AGAINST = {"activates": DOWN_CUES, "driver_of": DOWN_CUES, "inhibits": UP_CUES, "indirect_inhibitor": UP_CUES}
TIERS = {"AGREE": "RELATION-SCREENED", "HOLLOW": "LEXICAL-COOCCURRENCE", "REJECT": "UNCITED"}
_BLOCKING = [
    r"\binhibit(?:s|ed|ing|ion|or|ors)?\b", r"\bantagoni(?:se|ze|st|sm)\w*\b", r"\bblock(?:s|ed|ing|ade)?\b", r"\bsuppress(?:es|ed|ing|ion)?\b",
    r"\bdownregulat\w+\b", r"\babrogat\w+\b", r"\bsilenc\w+\b",
]
PREDICATES = {
    "driver_of": [
        r"\bdriv(?:e|es|en|ing|er|ers)\b", r"\boncogen(?:e|es|ic)\b", r"\btumou?rigen(?:ic|esis)\b", r"\bcarcinogen(?:ic|esis)\b", r"\bpathogenesis\b",
        r"\bcaus(?:e|es|ed|ing|al|ative)\b", r"\bpromot(?:e|es|ed|ing|ion)\b", r"\bcontribut(?:e|es|ed|ing)\b",
    ],
    "inhibits": _BLOCKING,
    "activates": [
        r"\bactivat(?:e|es|ed|ing|ion)\b", r"\bagonist\b", r"\binduc(?:e|es|ed|ing|tion)\b", r"\bupregulat\w+\b", r"\bstimulat\w+\b", r"\bpotentiat\w+\b",
        r"\bpromot(?:e|es|ed|ing|ion)\b",
    ],
    "phosphorylates": [r"\bphosphorylat\w+\b"],
    "indirect_inhibitor": _BLOCKING,
}
HEDGES = [
    r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bpossibl[ey]\b", r"\bpotential(?:ly)?\b", r"\bsuggest(?:s|ed|ing)?\b", r"\bappears? to\b", r"\bseems? to\b",
    r"\blikely\b", r"\bputative\b", r"\bpresumabl[ey]\b", r"\bhypothes\w+\b",
]
DENIALS = [
    r"\bunknown\b", r"\bunclear\b", r"\bnot\s+(?:yet\s+)?(?:known|clear|established|determined)\b", r"\bremains?\s+(?:to\s+be|unclear|unknown|elusive)\b", r"\bno\s+evidence\b",
    r"\bfail(?:s|ed)?\s+to\b", r"\bdid\s+not\b", r"\bdoes\s+not\b", r"\bwas\s+not\b", r"\bwithout\s+(?:any\s+)?effect\b", r"\bnon-?significant\b",
]
CONTRASTS = [
    r"\bnot\s+associated\b", r"\bin\s+contrast\b", r"\bunlike\b", r"\bwhereas\b", r"\brather\s+than\b", r"\blower\s+in\b", r"\bless\s+(?:relevant|common|frequent)\b",
    r"\bexcept\b", r"\bother\s+than\b", r"\bas\s+opposed\s+to\b",
]
#: What it means to promote is the other direction.
OPPOSITE_ENDS = [
    r"\bapoptosis\b", r"\bcell\s+death\b", r"\bautophagic\s+death\b", r"\bdifferentiation\b", r"\bsenescence\b", r"\bferroptosis\b", r"\bpyroptosis\b",
    r"\bcell\s+cycle\s+arrest\b", r"\bgrowth\s+arrest\b", r"\bchemosensitivity\b", r"\bdrug\s+sensitivity\b",
]
RAISES = r"\bpromot|induc|activat|enhanc"
LISTS = r"\(([^)]*)\)|(?:such as|including|e\.g\.,?|namely)([^.;]*)"
SYMBOL = r"\b(?=[A-Za-z\-]*\d)[A-Za-z][A-Za-z0-9\-]{2,}\b"
MECHANISMS = [
    ("inhibits", ["inhibit", "antagonist", "blocker", "negative"]), ("activates", ["agonist", "activat", "inducer", "positive"]),
    ("modulates", ["modulator", "regulator"]), ("binds", ["bind", "ic50", "ki", "kd"]),
]
QUANTITIES = {
    "ic50": r"IC50[:\s=]+([0-9.]+)\s*(nM|μM|uM|mM|nm|um|mm)",
    "response_rate": r"(?:response rate|ORR)[:\s=]+([0-9.]+)\s*%",
    "hazard_ratio": r"(?:HR|hazard ratio)[:\s=]+([0-9.]+)",
    "mutation_frequency": r"([0-9.]+)\s*%\s*(?:of|in)\s+(?:patients|tumors|samples)",
}
# --------------------------------------------------------------------------------------------------


def found(text: Column, patterns: Sequence[str]) -> Column:
    """What the first of the patterns that occurs has matched first, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def stem(text: Column, stems: Sequence[str]) -> Column:
    """The first of the stems that the text contains anywhere, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(s)), F.lit(s)) for s in stems])


def by_relation(relation: Column, table: dict[str, Sequence[str]], test: Callable[[Sequence[str]], Column]) -> Column:
    return reduce(lambda made, name: F.when(relation == name, test(table[name])).otherwise(made), table, F.lit(None).cast("string"))


def mentions(text: Column, term: Column) -> Column:
    """term, its underscores being spaces, stands in the text as a word, with or without a plural s."""
    quoted = F.replace(F.replace(term, F.lit("_"), F.lit(" ")), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.coalesce(F.rlike(text, F.concat(F.lit(r"(?iU)\b\Q"), quoted, F.lit(r"\Es?\b"))), F.lit(False))


@dataclass(frozen=True)
class Claim:
    subject: Column
    object: Column
    relation: Column
    sentence: Column

    @property
    def low(self) -> Column:
        return F.lower(self.sentence)

    @staticmethod
    def of(sentence: Column | None = None) -> Claim:
        return Claim(F.col("subject"), F.col("object"), F.col("relation"), F.trim(F.coalesce(F.col("sentence") if sentence is None else sentence, F.lit(""))))


@dataclass(frozen=True)
class Rule:
    verdict: str
    reason: str
    test: Callable[[Claim], Column]


def whenever(test: Callable[[Claim], Column]) -> Callable[[Claim], Column]:
    """A test that finds no word of its own."""
    return lambda c: F.when(test(c), F.lit(""))


def judged(claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """claims with verdict, reason and keyword ('' where the rule found none); the last rule should
    always hold."""
    claim = Claim.of()
    tests = {f"_t{i}": r.test(claim) for i, r in enumerate(rules)}
    said = [F.when(F.col(t).isNotNull(), F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.reason).alias("reason"), F.col(t).alias("keyword"))) for t, r in zip(tests, rules)]
    return claims.withColumns(tests).withColumn("_j", F.coalesce(*said)).select(*claims.columns, "_j.*")


def verdict_by(rules: Sequence[Rule]) -> Column:
    """The verdict alone, as a column over claims: a verifier."""
    return F.coalesce(*[F.when(r.test(Claim.of()).isNotNull(), F.lit(r.verdict)) for r in rules])


def gate_rules(keywords: dict = KEYWORDS, against: dict = AGAINST) -> list[Rule]:
    """Does a proof sentence support the relation, or only name both ends?"""
    return [
        Rule("REJECT", "no proof sentence", whenever(lambda c: c.sentence == "")),
        Rule("REJECT", "not both entities", whenever(lambda c: ~(mentions(c.sentence, c.subject) & mentions(c.sentence, c.object)))),
        Rule("HOLLOW", "polarity conflict", lambda c: by_relation(c.relation, against, lambda cues: stem(c.low, cues))),
        Rule("HOLLOW", "no vocabulary", whenever(lambda c: ~F.coalesce(c.relation.isin(*keywords), F.lit(False)))),
        Rule("AGREE", "keyword", lambda c: by_relation(c.relation, keywords, lambda stems: stem(c.low, stems))),
        Rule("HOLLOW", "no keyword", whenever(lambda c: F.lit(True))),
    ]


def elsewhere(c: Claim) -> Column:
    """The first list of two symbols or more in the sentence that does not name the subject."""
    spans = F.zip_with(F.regexp_extract_all(c.sentence, F.lit("(?i)" + LISTS), F.lit(1)), F.regexp_extract_all(c.sentence, F.lit("(?i)" + LISTS), F.lit(2)), lambda a, b: F.concat(a, b))
    subject = F.lower(F.replace(c.subject, F.lit("_"), F.lit(" ")))
    symbols = F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(SYMBOL), F.lit(0)))
    other = F.filter(symbols, lambda s: (F.size(s) >= 2) & ~F.exists(s, lambda x: F.contains(F.lower(x), subject)))
    return F.when(F.size(other) > 0, F.array_join(F.slice(F.get(other, F.lit(0)), 1, 4), ", "))


def guard_rules(predicates: dict = PREDICATES) -> list[Rule]:
    """Guards of claims whose direction is their content. Without a parse nothing is better than
    hedged."""
    return [
        Rule("REJECTED", "no proof sentence", whenever(lambda c: c.sentence == "")),
        Rule("REJECTED", "not both entities", whenever(lambda c: ~(mentions(c.sentence, c.subject) & mentions(c.sentence, c.object)))),
        Rule("REJECTED", "contrast", lambda c: found(c.low, CONTRASTS)),
        Rule("REJECTED", "negated", lambda c: found(c.low, DENIALS)),
        Rule("REJECTED", "no vocabulary", whenever(lambda c: ~F.coalesce(c.relation.isin(*predicates), F.lit(False)))),
        Rule("REJECTED", "no predicate", whenever(lambda c: by_relation(c.relation, predicates, lambda p: found(c.sentence, [f"(?i){x}" for x in p])).isNull())),
        Rule("REJECTED", "polarity inversion", lambda c: F.when(c.relation.isin("driver_of", "activates") & F.rlike(c.low, F.lit(RAISES)), found(c.low, OPPOSITE_ENDS))),
        Rule("REJECTED", "attributed elsewhere", elsewhere),
        Rule("HEDGED", "hedged", lambda c: found(c.low, HEDGES)),
        Rule("HEDGED", "no parse", lambda c: by_relation(c.relation, predicates, lambda p: found(c.sentence, [f"(?i){x}" for x in p]))),
    ]


def proof_sentences(abstracts: DataFrame, keywords: dict = KEYWORDS, against: dict = AGAINST) -> DataFrame:
    """Abstracts (subject, object, relation, text, ...) with sentence, has_keyword: the first
    sentence that names both ends, is in no polarity conflict and holds a keyword, else the first
    without a keyword, else null. Sentences end with . ! or ? before blanks."""
    sentences = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+")
    subject, object_, relation = F.col("subject"), F.col("object"), F.col("relation")

    def fits(s: Column) -> Column:
        return mentions(s, subject) & mentions(s, object_) & by_relation(relation, against, lambda cues: stem(F.lower(s), cues)).isNull()

    rows = abstracts.withColumn("_fit", F.filter(sentences, fits))
    keyed = F.filter("_fit", lambda s: by_relation(relation, keywords, lambda stems: stem(F.lower(s), stems)).isNotNull())
    rows = rows.withColumn("_key", keyed)
    first = lambda c: F.trim(F.get(c, F.lit(0)))
    return rows.withColumn("sentence", F.coalesce(first("_key"), first("_fit"))).withColumn("has_keyword", F.size("_key") > 0).drop("_fit", "_key")


def relation_of(mechanism: Column) -> Column:
    """The first relation whose words a mechanism's text has; none: targets."""
    low = F.lower(F.coalesce(mechanism, F.lit("unknown")))
    return F.coalesce(*[F.when(stem(low, words).isNotNull(), F.lit(name)) for name, words in MECHANISMS], F.lit("targets"))


def outcomes(trials: DataFrame) -> DataFrame:
    """Trials (trial, measures: array of (measure, description), in order) -> trial, response_rate,
    pfs_months, os_months, os_hazard_ratio, each of the last measure that names it and gives a number."""
    number = lambda text, p: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")).cast("double")
    kinds = {
        "response_rate": (["response rate", "orr"], lambda d: number(d, r"(\d+(?:\.\d+)?)\s*%") / 100.0),
        "pfs_months": (["progression-free survival", "pfs"], lambda d: number(d, r"(?i)(\d+(?:\.\d+)?)\s*months?")),
        "os_months": (["overall survival", "os"], lambda d: number(d, r"(?i)(\d+(?:\.\d+)?)\s*months?")),
        "os_hazard_ratio": (["overall survival", "os"], lambda d: number(d, r"(?i)(?:HR|hazard ratio)[:\s=]+(\d+(?:\.\d+)?)")),
    }

    def last(words: list[str], value: Callable[[Column], Column]) -> Column:
        named = F.filter("measures", lambda m: stem(F.lower(F.coalesce(m["measure"], F.lit(""))), words).isNotNull())
        given = F.filter(F.transform(named, lambda m: value(m["description"])), lambda x: x.isNotNull())
        return F.get(F.reverse(given), F.lit(0))

    return trials.select("trial", *[last(*how).alias(name) for name, how in kinds.items()])


# --- quantities ---------------------------------------------------------------------------------------
_SOUND = {"ic50": (0.001, 1000, 0.8, 0.5), "response_rate": (0.0, 1.0, 0.9, 0.3), "hazard_ratio": (0.1, 5.0, 0.85, 0.4), "mutation_frequency": (0.0, 1.0, 0.7, 0.3)}
_UNITS = {"ic50": "μM", "response_rate": "proportion", "hazard_ratio": "HR", "mutation_frequency": "proportion"}
_COMPILED = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in QUANTITIES.items()]


def read_value(kind: str, match: re.Match) -> float | None:
    try:
        value = float(match[1])
    except ValueError:  # such as 1.2.3
        return None
    if kind == "ic50":
        return {"nm": value / 1000.0, "mm": value * 1000.0}.get(match[2].lower(), value)
    return value if kind == "hazard_ratio" else value / 100.0


def confirmed(kind: str, value: float, low: str) -> str:
    """Specific, general or none: is the value, or at least its kind, said in the lower-cased text?"""
    forms = {
        "ic50": [f"ic50 = {value:.2f}", f"ic50={value:.2f}", f"ic50 {value:.1f}", f"ic50 = {value * 1000:.1f}", f"ic50={value * 1000:.1f}", f"ic50 {value * 1000:.0f}", "ic50"],
        "mutation_frequency": [f"{value * 100:.1f}%", f"{value * 100:.0f}%", f"{int(value * 100)}%", "mutation"],
        "hazard_ratio": [f"hr {value:.2f}", f"hr = {value:.2f}", f"hr={value:.2f}", f"hazard ratio {value:.2f}", "hazard ratio", "hr "],
    }.get(kind, [])
    hit = next((i for i, f in enumerate(forms) if f in low), None)
    return "none" if hit is None else "specific" if hit < len(forms) - 1 else "general"


def quantities(texts: DataFrame, key: str) -> DataFrame:
    """Texts (key, text) -> key, kind, place (character), value, unit, confidence, context (50
    characters on both sides, 80 of frequencies), status. Null text has none; what is no number is left
    out."""
    names = ["kind", "place", "value", "unit", "confidence", "context", "status"]

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                low = (text or "").lower()
                for kind, pattern in _COMPILED:
                    width = 80 if kind == "mutation_frequency" else 50
                    for m in pattern.finditer(text or ""):
                        value = read_value(kind, m)
                        if value is not None:
                            least, most, sure, unsure = _SOUND[kind]
                            ids.append(i)
                            out.append((kind, m.start(), value, _UNITS[kind], sure if least <= value <= most else unsure, text[max(0, m.start() - width) : m.end() + width], confirmed(kind, value, low)))
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.string()]
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[key, *names])

    return texts.select(key, "text").mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, kind string, place int, value double, unit string, confidence double, context string, status string")
