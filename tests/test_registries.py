"""Record readers on foreign records: other forms, missing parts, broken lines; and the sinks."""

import gzip
import json

from pyspark.sql import functions as F

from graphev.sources import registries


def snak(kind, value):
    return {"mainsnak": {"datavalue": {"type": kind, "value": value}, "snaktype": "value"}, "rank": "normal"}


ENTITIES = [
    {"id": "Q1", "labels": {"en": {"language": "en", "value": "One"}, "de": {"value": "Eins"}}, "descriptions": {"en": {"value": "first"}}, "aliases": {"en": [{"value": "uno"}, {"value": "I"}]},
     "claims": {"P31": [snak("wikibase-entityid", {"entity-type": "item", "id": "Q5"}), snak("wikibase-entityid", {"numeric-id": 6})], "P569": [snak("time", {"time": "+1900", "precision": 9})], "P99": [snak("string", "s"), snak("string", "")], "P98": [snak("quantity", {"amount": "1"})]},
     "sitelinks": {"enwiki": {"title": "One"}, "dewiki": {}}},
    {"id": "Q2", "labels": {"de": {"value": "Zwei"}}},
    {"id": "", "labels": {}},
    {"labels": {"en": {"value": "no id"}}},
]


def test_entities_in_every_form_of_file(spark, tmp_path):
    lines = [json.dumps(e) for e in ENTITIES]
    forms = {"lines": "\n".join([*lines, "", "{broken", "  "]), "commas": "[\n" + ",\n".join(lines) + "\n]\n", "array": json.dumps(ENTITIES)}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
        rows = {r.id: r for r in registries.load_entities(spark, str(tmp_path / f"{name}.json")).collect()}
        assert set(rows) == {"Q1", "Q2"}
        one, two = rows["Q1"], rows["Q2"]
        assert (one.label, one.description, one.aliases) == ("One", "first", ["uno", "I"]) and one.sitelinks == {"enwiki": "One", "dewiki": ""}
        assert one.claims == {"instance_of": ["Q5"], "date_of_birth": ["+1900"], "P99": ["s", ""]}
        assert (two.label, two.description, two.aliases, two.claims) == ("Q2", None, [], {})
        assert [r.id for r in registries.load_entities(spark, str(tmp_path / f"{name}.json"), ["Q5", "Q9"]).collect()] == ["Q1"]


def test_studies(spark):
    full = {"hasResults": True, "protocolSection": {
        "identificationModule": {"nctId": "NCT1", "briefTitle": "T", "other": [1]}, "statusModule": {"overallStatus": "TERMINATED", "whyStopped": "slow", "completionDateStruct": {"date": "2020-01"}},
        "designModule": {"enrollmentInfo": {"count": 7, "type": "ACTUAL"}}, "referencesModule": {"references": [{"pmid": "1", "type": "RESULT"}, {"pmid": "2", "type": "BACKGROUND"}, {"type": "RESULT"}, {"pmid": "3"}, {"pmid": "4", "type": "DERIVED"}]}},
        "resultsSection": {"outcomeMeasuresModule": {"outcomeMeasures": [{"title": str(i)} for i in range(14)] + [{}]}, "participantFlowModule": {"groups": [1]}}}
    empty = {"protocolSection": {"designModule": {"enrollmentInfo": None}}, "resultsSection": {"participantFlowModule": {}}}
    rows = registries.studies(spark.createDataFrame([(json.dumps(full),), (json.dumps(empty),), ("{}",), ("nonsense",)], "value string")).orderBy("nct_id").collect()
    assert len(rows) >= 3
    one, blank = rows[-1].asDict(), rows[0].asDict()
    assert (one["nct_id"], one["why_stopped"], one["enrollment_count"], one["result_pmids"], one["background_pmids"], one["derived_pmids"]) == ("NCT1", "slow", 7, ["1"], ["2"], ["4"])
    assert (one["has_results"], one["outcome_measure_count"], one["outcome_measure_titles"], one["has_participant_flow"]) == (True, 15, [str(i) for i in range(12)], True)
    assert (blank["status"], blank["has_results"], blank["enrollment_count"], blank["result_pmids"], blank["has_participant_flow"]) == ("UNKNOWN", False, None, [], False)


def test_interaction_channels(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("i\tj\tA\tB\t9606\t900\t0\t0\t0\t1\t2\t0\t3\ni\tj\tA\tC\t9606\t400\t0\t0\t0\t0\t0\t0\t0\ni\tj\tA\tD\t9606\t150\ni\tj\tA\n")
    got = {tuple(r) for r in registries.load_interactions(spark, str(tmp_path / "i.tsv")).collect()}
    assert got == {("A", "B", 0.9, "experimental+textmining+coexpression"), ("A", "C", 0.4, "combined"), ("A", "D", 0.15, "combined")}


def test_associations(spark):
    kind = "protein string, disease string, overall double, parts array<struct<id: string, score: double>>"
    rows = [("P", "D", 0.5, [("literature", 0.9), ("somatic_mutation", 0.1), ("known_drug", 0.0)]), ("P", "E", 0.25, []), ("P", "F", 0.1, [("animal_model", 0.2)]), ("X", "D", 0.1, []), ("P", "P", 0.1, [])]
    objects = spark.createDataFrame([("P", "Protein"), ("D", "Disease"), ("E", "Disease"), ("F", "Disease")], "name string, type_name string")
    edges = spark.createDataFrame([("P", "F")], "source_name string, target_name string")
    got = {r.target_name: r for r in registries.associations(spark.createDataFrame(rows, kind), objects, edges).collect()}
    assert set(got) == {"D", "E"} and (got["D"].evidence_tier, got["D"].provenance, got["D"].breakdown) == ("ESTABLISHED", "OpenTargets_score_0.500", "literature=0.9;somatic_mutation=0.1")
    assert got["E"].evidence_tier == "HYPOTHESIS"


def test_external_network(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("id\tname\tkind\nc1\tImatinib \tC\nc2\tother\tC\nd1\tbreast cancer\tD\n")
    with gzip.open(tmp_path / "e.sif.gz", "wt") as f:
        f.write("source\tmetaedge\ttarget\nc1\tCtD\td1\nc1\tCtD\td1\nc2\tCtD\td1\nc1\tCpD\td1\nc1\tCtD\td9\n")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = registries.external_pairs(*registries.load_network(spark, str(tmp_path / "n.tsv"), str(tmp_path / "e.sif.gz")), names("IMATINIB"), names("Breast_Cancer", "AML"))
    assert [tuple(r) for r in got.collect()] == [("IMATINIB", "Breast_Cancer")]


def test_domain_match(spark):
    rows = [(["Amine", "AMIDE", "pyridine", "indole", "pyrazole"], "kinase"), (["amide", "phthalimide"], "ubiquitin_ligase"), (["amine", "amine"], "gpcr"), (["amine"], ""), (["amine"], None), ([], "kinase"), (None, "kinase")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g array<string>, d string").orderBy("i").select(F.round(registries.domain_match(F.col("g"), F.col("d")), 6)).collect()
    assert [r[0] for r in got] == [0.9, 0.8, 0.55, 0.5, 0.5, 0.5, None]


def test_sinks_write_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(3, None), (1, "a,b"), (2, "c")], "k int, b string")
    registries.write_worklist(rows, f"{tmp_path}/w", "k")
    registries.write_report(rows, f"{tmp_path}/r", "k")
    text = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert [x for x in text("w").splitlines() if x != "k,b"] == ['1,"a,b"', "2,c", "3,"] and [list(json.loads(x)) for x in text("r").splitlines()] == [["b", "k"]] * 3
