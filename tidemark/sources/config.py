"""Configuration read on the driver: small files of lists and names that become literals of expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession


def load_config(spark: SparkSession, path: str) -> dict:
    """The object of a JSON or YAML file that Spark can read; empty where the file is missing, broken or no object.

    YAML needs the yaml package; without it, a file that is no JSON raises an ImportError.
    """
    try:
        found = spark.read.option("wholetext", True).text(path).head()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    if found is None:
        return {}
    try:
        told = json.loads(found[0])
    except ValueError:
        import yaml

        try:
            told = yaml.safe_load(found[0])
        except yaml.YAMLError:
            return {}
    return told if isinstance(told, dict) else {}


def _once(words: Iterable) -> list[str]:
    said: dict[str, str] = {}
    for word in words:
        word = str(word or "").strip()
        if word:
            said.setdefault(word.casefold(), word)
    return list(said.values())


def taxonomy_terms(config: Mapping, section: str) -> list[str]:
    """The distinct terms of one section of a keyword taxonomy, in order, whatever their groups; entries are words or {"term": word}."""
    groups = (((config.get("generator") or {}).get("taxonomy") or {}).get(section)) or {}
    lists = [v for v in groups.values() if isinstance(v, list)] if isinstance(groups, Mapping) else []
    return _once(x.get("term") if isinstance(x, Mapping) else x for v in lists for x in v)


def profile_aliases(name: str, profile: Mapping) -> list[str]:
    """A profile's name and its aliases."""
    return [name, *map(str, profile.get("aliases") or [])]


def with_geo_aliases(profiles: Mapping[str, Mapping], extra: Mapping[str, Iterable]) -> dict[str, dict]:
    """Profiles with more aliases from a second file; names without a profile there are left out."""
    out = {}
    for name, profile in profiles.items():
        more = map(str, extra.get(name) or [])
        out[name] = {**profile, "aliases": list(dict.fromkeys([*map(str, profile.get("aliases") or []), *more]))}
    return out
