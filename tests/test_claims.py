"""Rule tables, quantities, trial outcomes and phrase joins on sentences with known answers."""

import pytest

from graphev.operators import claims, phrases
from graphev.plans import texts

GATE = [
    (("Vemurafenib", "BRAF", "inhibits", "Vemurafenib potently inhibits BRAF V600E kinase activity."), ("AGREE", "inhib")),
    (("ERK1", "MYC", "activates", "ERK1 and MYC were both detected in the tumor samples."), ("HOLLOW", "")),
    (("Sorafenib", "BRAF", "inhibits", "Sorafenib was administered to the patient cohort."), ("REJECT", "")),
    (("DrugX", "TargetY", "activates", "DrugX markedly decreased TargetY expression."), ("HOLLOW", "decreas")),
    (("MET", "X1", "inhibits", "metabolism of X1 is inhibited"), ("REJECT", "")),
    (("Breast_Cancer", "X1", "treats", "X1 treats breast cancers"), ("AGREE", "treat")),
    (("a.b", "c\\Ed", "binds", "a.b binds c\\Ed"), ("AGREE", "bind")),
    (("a.b", "c", "binds", "axb binds c"), ("REJECT", "")),
    (("A1", "B1", "unheard_of", "A1 and B1"), ("HOLLOW", "")),
    (("A1", "B1", None, "A1 and B1"), ("HOLLOW", "")),
    (("A1", "B1", "binds", "   "), ("REJECT", "")),
    (("A1", "B1", "binds", None), ("REJECT", "")),
    ((None, "B1", "binds", "B1 binds"), ("REJECT", "")),
]
GUARDS = [
    ("G1", "AML", "driver_of", "driver genes of G1 are lower in malignancies, e.g. AML", "contrast"),
    ("G1", "AML", "driver_of", "methylation of G1 promoter in AML", "no predicate"),
    ("G1", "AML", "driver_of", "The cause of AML in G1 carriers is still unknown", "negated"),
    ("G1", "AML", "driver_of", "G1 acts on AML through promoting apoptosis", "polarity inversion"),
    ("KEAP1", "AML", "driver_of", "two oncogenes (NrasG12D and MLL-AF9) cause AML beside KEAP1", "attributed elsewhere"),
    ("NRASG12D", "AML", "driver_of", "two oncogenes (NRASG12D and MLL-AF9) cause AML", "no parse"),
    ("G1", "AML", "driver_of", "G1 may drive AML", "hedged"),
    ("G1", "AML", "driver_of", "G1 drives AML", "no parse"),
    ("G1", "AML", "treats", "G1 treats AML", "no vocabulary"),
    ("G1", "AML", "driver_of", "G1 drives it", "not both entities"),
]


def test_relation_gate(spark):
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(GATE)], "i int, subject string, object string, relation string, sentence string")
    got = [(r.verdict, r.keyword) for r in claims.judged(rows, claims.gate_rules()).orderBy("i").collect()]
    assert got == [want for _, want in GATE]


def test_claim_guards(spark):
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(GUARDS)], "i int, subject string, object string, relation string, sentence string")
    got = claims.judged(rows, claims.guard_rules()).orderBy("i").collect()
    assert [r.reason for r in got] == [c[4] for c in GUARDS]
    assert {r.verdict for r in got if r.reason in ("hedged", "no parse")} == {"HEDGED"} and {r.verdict for r in got if r.reason not in ("hedged", "no parse")} == {"REJECTED"}


def test_rules_are_data(spark):
    rows = spark.createDataFrame([("a", "b", "likes", "a and b like tea")], "subject string, object string, relation string, sentence string")
    assert claims.judged(rows, claims.gate_rules({"likes": ["like"]}, {})).first().verdict == "AGREE"


def test_proof_sentences(spark):
    text = "A1 was seen. A1 and B1 meet! A1 inhibits B1? A1 inhibits and elevates B1. More."
    rows = spark.createDataFrame([(1, "A1", "B1", "inhibits", text), (2, "A1", "B1", "binds", text), (3, "A1", "Z", "binds", text), (4, "A1", "B1", "inhibits", None)], "i int, subject string, object string, relation string, text string")
    got = [(r.sentence, r.has_keyword) for r in claims.proof_sentences(rows).orderBy("i").collect()]
    assert got == [("A1 inhibits B1?", True), ("A1 and B1 meet!", False), (None, False), (None, False)]


def test_mechanism_words(spark):
    said = ["EGFR inhibitor", "receptor antagonist", "partial agonist", "inverse AGONIST blocker", "allosteric modulator", "binds IC50", "unknown thing", None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, m string").withColumn("r", claims.relation_of(claims.F.col("m")))
    assert [r.r for r in rows.orderBy("i").collect()] == ["inhibits", "inhibits", "activates", "inhibits", "modulates", "binds", "targets", "targets"]


def test_quantities(spark):
    text = "IC50 = 12.5 nM; ic50: 3 mM. ORR: 45% and hazard ratio 0.62, HR=9, 12.5% of patients. IC50 1.2.3 uM. IC50=2 µg"
    rows = claims.quantities(spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "k int, text string, value string"), "k").orderBy("kind", "place").collect()
    assert [(r.kind, r.value, r.unit, r.confidence) for r in rows] == [
        ("hazard_ratio", 0.62, "HR", 0.85), ("hazard_ratio", 9.0, "HR", 0.4), ("ic50", pytest.approx(0.0125), "μM", 0.8), ("ic50", 3000.0, "μM", 0.5), ("mutation_frequency", 0.125, "proportion", 0.7), ("response_rate", 0.45, "proportion", 0.9),
    ]
    assert all(text[r.place : r.place + 3].lower() in r.context.lower() for r in rows) and rows[2].context == text[: 14 + 50]
    assert [r.status for r in rows] == ["specific", "specific", "specific", "general", "specific", "none"]


def test_outcomes(spark):
    kind = "trial int, measures array<struct<measure: string, description: string>>"
    rows = [(1, [("Overall response rate", "seen in 45%"), ("ORR", "no number"), ("PFS", "14.5 months"), ("Overall Survival", "20 Month, HR=0.42"), ("OS", "21 months")]), (2, []), (3, None), (4, [(None, None)])]
    got = [tuple(r)[1:] for r in claims.outcomes(spark.createDataFrame(rows, kind)).orderBy("trial").collect()]
    assert got == [(0.45, 14.5, 21.0, 0.42), (None,) * 4, (None,) * 4, (None,) * 4]


def test_trial_matching(spark):
    """Salts and aliases are the drug, a longer word is not; conditions only by their aliases."""
    drugs = [("Cabozantinib", "Cabozantinib"), ("Dacomitinib", "Dacomitinib"), ("Dacomitinib", "PF-299804"), ("Adagrasib", "MRTX849"), ("Chloroquine", "Chloroquine"), ("Hydroxychloroquine", "Hydroxychloroquine"), ("None", ""), ("None", "--")]
    names = ["Cabozantinib S-Malate", "PF-299804 (Dacomitinib)", "MRTX849", "Hydroxychloroquine sulfate", "a b PF 299804 c", "PF 29980", None, ""]
    diseases = [("RCC", "renal cell carcinoma"), ("RCC", "kidney cancer"), ("STS", "sarcoma"), ("GIST", "gastrointestinal stromal tumor")]
    conditions = ["Metastatic Papillary Renal Cell Carcinoma", "Sarcoma", "Metastatic Gastrointestinal Stromal Tumor", "Advanced Solid Tumor", "renal-cell CARCINOMA; sarcoma", "cell renal carcinoma", None, "x"]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = phrases.trial_pairs(frame(list(enumerate(names)), "id int, name string"), frame(list(enumerate(conditions)), "id int, name string"), frame(drugs, "key string, phrase string"), frame(diseases, "key string, phrase string"))
    assert {tuple(r) for r in got.collect()} == {(0, "Cabozantinib", "RCC"), (1, "Dacomitinib", "STS"), (2, "Adagrasib", "GIST"), (4, "Dacomitinib", "RCC"), (4, "Dacomitinib", "STS")}
    assert {tuple(r) for r in phrases.phrase_hits(frame([(1, "x a b a b c")], "id int, name string"), frame([("k", "A, b! C"), ("n", "b b")], "key string, phrase string")).collect()} == {(1, "k")}


def test_sentences_of_the_queries_meet_all_rules(spark):
    verdicts = {(r.verdict, r.reason) for r in texts.guards_query(spark, "/root/testdata/sf0.001").select("verdict", "reason").distinct().collect()}
    assert {reason for _, reason in verdicts} >= {"contrast", "negated", "no vocabulary", "no predicate", "polarity inversion", "attributed elsewhere", "hedged", "no parse"}
