"""From extractions (structs of entities and triples) to rows fit for the graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.dates import clean_date
from graphloom.functions.text import canonical_predicate, is_phrase, is_referring, parse_json, trimmed
from graphloom.operators.errors import ExtractionError
from graphloom.operators.schema import EXTRACTION

#: Predicates of general use, by kind of corpus, and groups of which at most one can hold between two entities at a time.
PREDICATES = {
    "biography": ["wrote", "founded", "led", "invented", "discovered", "awarded", "child_of", "married_to", "parent_of", "sibling_of", "lived_in", "born_in", "moved_to", "died_in", "taught_at", "worked_for", "studied_at", "influenced", "succeeded", "member_of"],
    "fiction": ["loves", "hates", "serves", "betrays", "rescues", "fights", "kills", "friend_of", "enemy_of", "rival_of", "married_to", "child_of", "travels_to", "owns", "commands"],
    "finance": ["owns", "subsidiary_of", "acquired", "sold", "supplies", "customer_of", "competes_with", "invested_in", "owes", "reported", "increased", "decreased", "employs", "led_by", "audited_by", "regulated_by"],
}
EXCLUSIVE = {
    "biography": [["married_to", "divorced_from"], ["works_for", "left"]],
    "fiction": [["friend_of", "enemy_of"], ["loves", "hates"], ["serves", "betrays"]],
    "finance": [["increased", "decreased"], ["owns", "sold"], ["employs", "dismissed"]],
}


@dataclass(frozen=True)
class Rules:
    """What validation lets through."""

    vocabulary: list[str] | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    least_confidence: float = 0.0
    drop_negated: bool = False
    possessives: bool = False


def parse_extraction(reply: Column) -> Column:
    """A model's JSON reply, fenced or not; null where it is none, and never anything made up."""
    return parse_json(reply, EXTRACTION)


def require_progress(done: int, failed: int) -> None:
    """Partial failure is counted; total failure raises."""
    if failed and not done:
        raise ExtractionError(f"all of {failed} failed")


def entity_rows(extractions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(…, item, name, type, description, aliases) of entities that name something; other columns than ``extraction`` pass by."""
    rest = [c for c in extractions.columns if c != "extraction"]
    rows = extractions.select(*rest, F.posexplode("extraction.entities").alias("item", "e")).select(*rest, "item", "e.*")
    rows = rows.withColumns({"name": trimmed(F.col("name")), "type": F.coalesce(F.nullif(trimmed(F.col("type")), F.lit("")), F.lit("Concept")), "description": trimmed(F.col("description")), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})
    rows = rows.withColumn("aliases", F.array_distinct(F.filter(F.transform("aliases", trimmed), lambda a: (a != "") & (F.lower(a) != F.lower("name")))))
    return rows.where(~is_referring(F.col("name")) & ~is_phrase(F.col("name"), rules.possessives))


def triple_rows(extractions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(…, item, subject, predicate, object, …) of triples that say something: both ends named, not of a thing with itself, not below the rules' confidence.

    Predicates are canonical, confidence is held between 0 and 1 (1 where unsaid), validity clean.
    """
    rest = [c for c in extractions.columns if c != "extraction"]
    rows = extractions.select(*rest, F.posexplode("extraction.triples").alias("item", "t")).select(*rest, "item", "t.*")
    rows = rows.withColumns({
        "subject": trimmed(F.col("subject")), "object": trimmed(F.col("object")), "predicate": canonical_predicate(F.col("predicate"), rules.aliases, rules.vocabulary), "description": trimmed(F.col("description")),
        "negated": F.coalesce("negated", F.lit(False)), "confidence": F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)), "valid_from": clean_date(F.col("valid_from")), "valid_to": clean_date(F.col("valid_to")),
    })
    bad = F.lit(False)
    for c in ("subject", "object"):
        bad = bad | is_referring(F.col(c)) | is_phrase(F.col(c), rules.possessives)
    rows = rows.where(~bad & (F.col("predicate") != "") & (F.lower("subject") != F.lower("object")) & (F.col("confidence") >= rules.least_confidence))
    return rows.where("not negated") if rules.drop_negated else rows
