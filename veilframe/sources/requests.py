"""Requests and answers as JSON columns, and profiles from a configuration file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.types import KINDS
from veilframe.plans.pipeline import Profile


def _strings(body: Column, *keys: str) -> tuple[Column, Column]:
    """The object's properties of these names, the last of repeated ones, and whether all are strings."""
    parsed = F.from_json(body, F.lit(", ".join(f"`{k}` VARIANT" for k in keys)))
    text = [F.schema_of_variant(parsed[k]) == "STRING" for k in keys]
    ok = text[0]
    for t in text[1:]:
        ok = ok & t
    return F.struct(*[F.try_variant_get(parsed[k], "$", "string").alias(k) for k in keys]), F.coalesce(ok, F.lit(False))


def parse_request(body: Column) -> Column:
    """{payload, payload_id} of a JSON object; null unless both are strings. Of repeated properties the last counts."""
    values, ok = _strings(body, "payload", "payload_id")
    return F.when(ok, values)


def find_string(body: Column, key: str) -> Column:
    """The value of a top-level property if it is a string, else null. Of repeated ones the first string counts; key is taken as
    it is, dots and all. A body that is no object, or in which an object inside repeats a property, has none."""
    pairs = F.map_entries(F.from_json(body, "map<string,variant>"))
    text = F.filter(pairs, lambda e: (e["key"] == key) & (F.schema_of_variant(e["value"]) == "STRING"))
    return F.try_variant_get(F.get(text, F.lit(0))["value"], "$", "string")


def result_json(masked: Column) -> Column:
    return F.to_json(F.struct(masked.alias("result")))


def error_json(message: Column) -> Column:
    return F.to_json(F.struct(message.alias("error")))


def load_profiles(spark: SparkSession, path: str) -> dict[str, Profile]:
    """Profiles of a small YAML file: systems by name, each with flat settings. An unreadable file gives the default one."""
    try:
        rows = [r.value for r in spark.read.text(path).collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {"default": Profile()}
    out: dict[str, dict] = {}
    section = system = None
    for line in rows:
        line = line.split("#")[0].rstrip()
        if not line:
            continue
        depth, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        value = value.strip()
        if depth == 0:
            section = key
        elif section == "systems" and not value:
            system = key
            out[system] = {}
        elif section == "systems" and system:
            out[system][key] = [x.strip() for x in value.strip("[]").split(",")] if value.startswith("[") else value
    known = lambda v: None if v in (None, "all") else tuple(k for k in v if k in KINDS)
    return {
        name: Profile(name, s.get("enabled", "true") == "true", s.get("mask_mode", "stars"), s.get("demask", "true") == "true", known(s.get("pii_types")), known(s.get("irreversible")) or ())
        for name, s in out.items()
    } or {"default": Profile()}


def with_profile(df: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """df(system, ...) -> with allowed: whether the system is known and enabled."""
    enabled = [p.system for p in profiles.values() if p.enabled]
    return df.withColumn("allowed", F.coalesce(F.col("system").isin(*enabled) if enabled else F.lit(False), F.lit(False)))
