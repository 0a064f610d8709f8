"""Valid rows, conditions and duplicate rules of graded units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.clean import clean_id
from corpusmill.functions.text import normal_trigger


def valid_units(units: DataFrame, *columns: str) -> DataFrame:
    """id, revision and the given columns (all, if none is given) of valid rows: of each id the one with the highest revision.

    Equal revisions: the greater values of these columns. Null ids are ignored. Name the columns: only
    they are read and shuffled. Where a query needs no more of a text than a digest, a size or a count, take that
    first and name it instead of the text.
    """
    columns = columns or tuple(c for c in units.columns if c not in ("id", "revision"))
    return (
        units.where("id is not null")
        .groupBy(clean_id("id").alias("id"))
        .agg(F.max(F.struct("revision", *columns)).alias("row"))
        .select("id", "row.*")
    )


def _version(text: Column) -> Column:
    """The numbers of a dotted version as array<int>, filled up to four; null where it is none."""
    text = F.trim(text)
    numbers = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    filled = F.slice(F.concat(numbers, F.array(*[F.lit(0)] * 4)), 1, 4)
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+){0,3}$"), filled)


def version_status(spec: Column, observed: Column) -> Column:
    """matched, mismatch or unknown of a conjunction like '>=1.2,<2' and a version."""
    value = _version(observed)

    def holds(part: Column) -> Column:
        op, bound = F.regexp_extract(part, r"^\s*([<>=!~]=?)", 1), _version(F.regexp_extract(part, r"^\s*[<>=!~]=?\s*(.*)$", 1))
        return (
            F.when(op == ">=", value >= bound)
            .when(op == ">", value > bound)
            .when(op == "<=", value <= bound)
            .when(op == "<", value < bound)
            .when(op == "==", value == bound)
            .when(op == "!=", value != bound)
        )

    each = F.transform(F.split(spec, ","), holds)
    return (
        F.when(F.exists(each, lambda x: x.isNull()), "unknown")
        .when(F.forall(each, lambda x: x), "matched")
        .otherwise("mismatch")
    )


def match_conditions(units: DataFrame, observed: dict[str, str]) -> DataFrame:
    """Three-valued applicability of each unit's ``conditions`` (JSON map) to observed facts: id, status, open_keys.

    A key is unknown where either side says so or the fact is not supplied; ``any`` and ``general`` always
    match; a list allows its members; ``exact_set`` demands the whole set; a nested map compares the
    versions of its members, facts being named ``key.member``. A mismatch outweighs an unknown, and both
    outweigh a match; ``open_keys`` are the unknown keys in order, joined by commas. Conditions that are
    null or broken are unknown. Each distinct set of conditions is matched once and joined back.
    """
    keyed = units.select("id", F.coalesce("conditions", F.lit("")).alias("conditions"))
    sets = keyed.select("conditions").distinct()
    items = sets.select("conditions", F.explode_outer(F.from_json("conditions", "map<string,string>")).alias("key", "want"))
    facts = F.create_map(*[F.lit(x) for kv in observed.items() for x in kv])
    have = facts[F.col("key")]
    want_list = F.from_json("want", "array<string>")
    members = F.map_entries(F.from_json("want", "map<string,string>"))
    nested = F.transform(
        members, lambda m: F.coalesce(version_status(m["value"], facts[F.concat("key", F.lit("."), m["key"])]), F.lit("unknown"))
    )
    exact = F.from_json(F.get_json_object("want", "$.exact_set"), "array<string>")
    status = (
        F.when(F.col("key").isNull(), "unknown")
        .when((F.col("want") == "unknown") | F.coalesce(F.array_contains(want_list, "unknown"), F.lit(False)), "unknown")
        .when(have == "unknown", "unknown")
        .when(F.col("want").isin("any", "general") | F.coalesce(F.arrays_overlap(want_list, F.array(F.lit("any"), F.lit("general"))), F.lit(False)), "matched")
        .when(exact.isNotNull(), F.when(have.isNull(), "unknown").when(F.array_sort(exact) == F.array_sort(F.coalesce(F.from_json(have, "array<string>"), F.array(have))), "matched").otherwise("mismatch"))
        .when(
            F.col("want").startswith("{"),
            F.when(F.array_contains(nested, "mismatch"), "mismatch").when(F.array_contains(nested, "unknown"), "unknown").otherwise("matched"),
        )
        .when(have.isNull(), "unknown")
        .when(F.col("want").startswith("["), F.when(F.array_contains(want_list, have), "matched").otherwise("mismatch"))
        .when(F.col("want").rlike("^[<>=!~]"), version_status(F.col("want"), have))
        .otherwise(F.when(F.col("want") == have, "matched").otherwise("mismatch"))
    )
    outcomes = (
        items.select("conditions", "key", status.alias("status"))
        .groupBy("conditions")
        .agg(
            F.max(F.when(F.col("status") == "mismatch", 2).when(F.col("status") == "unknown", 1).otherwise(0)).alias("worst"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "unknown", F.col("key")))), ",").alias("open_keys"),
        )
    )
    return keyed.join(outcomes, "conditions").select(
        "id", F.element_at(F.array(F.lit("matched"), F.lit("unknown"), F.lit("mismatch")), F.col("worst") + 1).alias("status"), "open_keys"
    )


def rule_key(*, body_only: bool = False) -> Column:
    """SHA-256 of a unit's rule: body and conditions, and unless ``body_only`` tier, category, strength and parents."""
    parts = ["body", "conditions"] + ([] if body_only else ["tier", "category", "evidence_strength"])
    values = [F.coalesce(c, F.lit("\x00")) for c in parts]
    if not body_only:
        values.append(F.coalesce(F.array_join(F.array_sort("inherits_from"), "\x02"), F.lit("\x00")))
    return F.sha2(F.concat_ws("\x01", *values), 256)


def duplicate_rules(units: DataFrame) -> DataFrame:
    """Groups of units (id, rule of ``rule_key``, provenance) with the same rule: rule, units, first_id, variants (distinct
    provenances), disposition."""
    provenance = F.to_json("provenance")
    groups = units.select("id", "rule", F.coalesce(provenance, F.lit("")).alias("provenance"))
    return (
        groups.groupBy("rule")
        .agg(F.count("*").alias("units"), F.min("id").alias("first_id"), F.countDistinct("provenance").alias("variants"))
        .where("units > 1")
        .withColumn(
            "disposition",
            F.when(F.col("variants") > 1, "other_source").otherwise("same_source"),
        )
    )


def trigger_classes(units: DataFrame) -> DataFrame:
    """Units whose triggers have the same set of words, of which conditions or parents differ.

    triggers (the words), units, first_id, condition_sets. Units without trigger words are left out; units
    are grouped by the set itself, never paired.
    """
    strings = F.concat(
        F.coalesce("triggers.error_signatures", F.array().cast("array<string>")),
        F.coalesce("triggers.keywords", F.array().cast("array<string>")),
    )
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(strings, lambda x: x.isNotNull()), lambda x: F.split(normal_trigger(x), " ")))))
    words = F.array_join(F.filter(words, lambda w: w != ""), " ")
    return (
        units.select("id", words.alias("triggers"), F.coalesce("conditions", F.lit("")).alias("conditions"))
        .where("triggers != ''")
        .groupBy("triggers")
        .agg(F.count("*").alias("units"), F.min("id").alias("first_id"), F.countDistinct("conditions").alias("condition_sets"))
        .where("units > 1 and condition_sets > 1")
    )


def with_size(units: DataFrame) -> DataFrame:
    """The units with ``bytes`` of their body, 0 for a null one."""
    return units.withColumn("bytes", F.octet_length(F.coalesce("body", F.lit(""))))


def shard_metrics(units: DataFrame) -> DataFrame:
    """Of units with domain_path and bytes: kind (leaf, subtree, federation), path, units, bytes, estimated_tokens: one pass, each unit counted at each level.

    A path's parts are those of ``domain_path``; the subtree is the path without its last part where it has
    three, else its first two; null and empty paths count as '.'.
    """
    parts = F.filter(F.split(F.coalesce("domain_path", F.lit("")), "/"), lambda p: (p != "") & (p != "."))
    name = lambda p: F.when(F.size(p) == 0, ".").otherwise(F.array_join(p, "/"))
    subtree = F.when(F.size("parts") >= 3, F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.slice("parts", 1, 2))
    levels = F.array(
        F.struct(F.lit("leaf").alias("kind"), name(F.col("parts")).alias("path")),
        F.struct(F.lit("subtree").alias("kind"), name(subtree).alias("path")),
        F.struct(F.lit("federation").alias("kind"), name(F.slice("parts", 1, 1)).alias("path")),
    )
    rows = units.select(parts.alias("parts"), "bytes", F.ceil(F.col("bytes") / 4).alias("tokens"))
    return (
        rows.select(F.explode(levels).alias("level"), "bytes", "tokens")
        .groupBy("level.kind", "level.path")
        .agg(
            F.count("*").alias("units"), F.sum("bytes").alias("bytes"), F.sum("tokens").cast("bigint").alias("estimated_tokens")
        )
    )
