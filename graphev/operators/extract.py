"""Drug-target pairs from relational tables of mechanisms and measured activities, merged by source.

Tables: molecules (molregno, chembl_id, pref_name, max_phase), targets (tid, target_id, organism,
target_type), target_components (tid, component_id), synonyms (component_id, synonym, syn_type),
mechanisms (mec_id, molregno, tid, mechanism_of_action, action_type), mechanism_refs (mec_id, ref_id),
docs (doc_id, pubmed_id, doi, chembl_id), activities (molregno, assay_id, doc_id, pchembl, standard_type),
assays (assay_id, tid, assay_type, confidence_score). Facts are joined with their dimensions by keys;
which dimension is small enough to be broadcast is left to its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphev.operators.claims import relation_of

#: Endings that name a salt or form.
SALT_ENDINGS = [
    "DIHYDROCHLORIDE", "HYDROCHLORIDE", "DIMALEATE", "MALEATE", "DITOSYLATE", "TOSYLATE", "MESYLATE", "BESYLATE", "TARTRATE", "HEMIFUMARATE", "FUMARATE", "CITRATE",
    "SUCCINATE", "MALONATE", "SULFATE", "PHOSPHATE", "SODIUM", "POTASSIUM", "CALCIUM", "ACETATE", "BROMIDE", "CHLORIDE", "NITRATE", "ETHYLSUCCINATE", "ETABONATE",
    "XINAFOATE", "PIVOXIL", "AXETIL", "DIPIVOXIL", "DISOPROXIL", "ALAFENAMIDE", "MARBOXIL",
]


def drug_name(raw: Column, endings: list[str] = SALT_ENDINGS) -> Column:
    """Upper-cased, without salt endings (longest first, each once), then every stretch of letters in
    title case."""
    name = F.trim(F.upper(raw))
    for salt in sorted(endings, key=len, reverse=True):
        name = F.trim(F.regexp_replace(name, f" {salt}$", ""))
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def single_proteins(targets: DataFrame, components: DataFrame, synonyms: DataFrame) -> DataFrame:
    """tid, target_id, symbol: human single proteins with their gene symbols."""
    human = targets.filter("organism = 'Homo sapiens' and target_type = 'SINGLE PROTEIN'").select("tid", "target_id")
    symbols = synonyms.filter("syn_type = 'GENE_SYMBOL' and synonym is not null").select("component_id", F.col("synonym").alias("symbol"))
    return human.join(components.select("tid", "component_id"), "tid").join(symbols, "component_id").select("tid", "target_id", "symbol").distinct()


def by_phase(phase: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + phase * 0.15)


def citation(*given: tuple[str, Column]) -> Column:
    """The first of the names that is there and not empty, behind its prefix."""
    return F.coalesce(*[F.when(c.cast("string") != "", F.concat(F.lit(prefix), c.cast("string"))) for prefix, c in given])


def _known(molecules: DataFrame, approved_only: bool) -> DataFrame:
    rows = molecules.filter("max_phase = 4" if approved_only else "max_phase >= 1").filter("pref_name <> ''")
    return rows.select("molregno", F.col("chembl_id").alias("drug_id"), "pref_name", F.col("max_phase").cast("int").alias("phase"))


def from_mechanisms(mechanisms: DataFrame, molecules: DataFrame, proteins: DataFrame, refs: DataFrame, docs: DataFrame, approved_only: bool = True) -> DataFrame:
    """A10: drug, target, drug_id, target_id, score, moa, phase, provenance, source and rank (where a row
    stands in its source: by phase, then name)."""
    cited = refs.join(docs.withColumnRenamed("doc_id", "ref_id"), "ref_id", "left").select("mec_id", "pubmed_id", "doi")
    rows = mechanisms.join(_known(molecules, approved_only), "molregno").join(proteins, "tid").join(cited, "mec_id", "left")
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return rows.select(
        drug_name(F.col("pref_name")).alias("drug"), F.col("symbol").alias("target"), "drug_id", "target_id", by_phase(F.col("phase")).alias("score"),
        F.concat(said("action_type"), F.lit(": "), said("mechanism_of_action")).alias("moa"), "phase", citation(("PMID:", F.col("pubmed_id")), ("DOI:", F.col("doi")), ("ChEMBL:", F.col("drug_id"))).alias("provenance"),
        F.lit("mechanism").alias("source"), F.struct(F.lit(0).alias("source"), (-F.col("phase")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("pref_name").alias("name")).alias("rank"),
    ).distinct()


def from_activities(activities: DataFrame, assays: DataFrame, molecules: DataFrame, proteins: DataFrame, docs: DataFrame, least: float = 6.0, approved_only: bool = True) -> DataFrame:
    """The same of binding assays with a confidence of 8 or more and a pChEMBL value of ``least`` or
    more; a row's place is by that value, then phase."""
    tested = assays.filter("assay_type = 'B' and confidence_score >= 8").select("assay_id", "tid")
    read = docs.select("doc_id", "pubmed_id", "doi", F.col("chembl_id").alias("doc_chembl_id"))
    rows = activities.filter(F.col("pchembl") >= least).join(_known(molecules, approved_only), "molregno").join(tested, "assay_id").join(proteins, "tid").join(read, "doc_id", "left")
    measured = F.least(F.lit(1.0), 0.4 + (F.col("pchembl") - 5.0) * 0.12)
    return rows.select(
        drug_name(F.col("pref_name")).alias("drug"), F.col("symbol").alias("target"), "drug_id", "target_id", (measured * 0.7 + by_phase(F.col("phase")) * 0.3).alias("score"),
        F.concat(F.coalesce(F.nullif(F.col("standard_type"), F.lit("")), F.lit("unknown")), F.lit(": pChEMBL="), F.format_string("%.1f", F.col("pchembl").cast("double"))).alias("moa"), "phase",
        citation(("PMID:", F.col("pubmed_id")), ("DOI:", F.col("doi")), ("ChEMBL_DOC:", F.col("doc_chembl_id")), ("ChEMBL:", F.col("drug_id"))).alias("provenance"),
        F.lit("bioactivity").alias("source"), F.struct(F.lit(1).alias("source"), (-F.col("pchembl")).cast("double").alias("x"), (-F.col("phase")).cast("double").alias("y"), F.col("pref_name").alias("name")).alias("rank"),
    ).distinct()


def first_wins(*sources: DataFrame, keys: tuple[str, ...] = ("drug", "target")) -> DataFrame:
    """One row per key, the one with the lowest rank over all sources; ties by the row's other values,
    as a source has no order of its own. One grouping, combined before it moves."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    rest = [c for c in rows.columns if c not in (*keys, "rank")]
    return rows.groupBy(*keys).agg(F.min(F.struct("rank", *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def edges_of(pairs: DataFrame) -> DataFrame:
    """Source, target, relation (from the mechanism's text), confidence, provenance."""
    return pairs.select(F.col("drug").alias("source"), "target", relation_of(F.col("moa")).alias("relation"), F.round("score", 3).alias("confidence"), "provenance")
