"""Leak scanning, JSON and map merges."""

from __future__ import annotations

import json
from urllib.parse import quote, quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def canary_hits(artifacts: DataFrame, canaries: list[str]) -> DataFrame:
    """(artifact, canary, form) of each planted secret that an artifact (artifact, content) holds, plain or encoded.

    The canaries are a short list of the caller's; each form is a literal of one scan.
    """
    forms = [(c, name, text) for c in canaries for name, text in dict(plain=c, url=quote(c, safe=""), form=quote_plus(c), json=json.dumps(c)[1:-1]).items()]
    held = F.array(*(F.when(F.contains("content", F.lit(text)), F.struct(F.lit(c).alias("canary"), F.lit(name).alias("form"))) for c, name, text in forms))
    return artifacts.select("artifact", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("hit")).select("artifact", "hit.*")


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps, the second's value where a key is in both."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def last_by_key(items: Column, key: str) -> Column:
    """An array of structs with only the last item of each key, in order."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y[key].eqNullSafe(x[key])))


def closed(json_text: Column, kinds: dict[str, str]) -> Column:
    """Whether a JSON object has exactly the keys of ``kinds`` with values of their types (int, bool or one of a|b|c)."""
    keys = F.array_sort(F.json_object_keys(json_text))
    good = keys == F.array(*map(F.lit, sorted(kinds)))
    for k, kind in kinds.items():
        value = F.get_json_object(json_text, f"$.{k}")
        pattern = r"^-?\d+$" if kind == "int" else "^(true|false)$" if kind == "bool" else f"^({kind})$"
        good = good & F.coalesce(value.rlike(pattern), F.lit(False))
    return F.coalesce(good, F.lit(False))


def etag(*columns: Column) -> Column:
    """A weak tag that changes with any of the columns."""
    return F.concat(F.lit('W/"'), F.left(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), F.lit(32)), F.lit('"'))


def selectable(source_valid: Column, source_changed: Column, status: Column, parent_status: Column, label: Column, corrected: Column, known: list[str], longest: int = 160) -> Column:
    """selectable, or why a reported statement may not be carried out of its source: source, changed, status, parent, label.

    A label that was read by itself must be one of ``known``, as it may be a clause with more in it than was chosen; one set by
    hand may be any of at most ``longest`` signs.  A null source state or label is never carried; a null status closes nothing.
    """
    closed_by = lambda x: F.coalesce(x.isin("EXCLUDED", "DEFERRED"), F.lit(False))
    sure = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(~sure(source_valid), "source")
        .when(~sure(~source_changed), "changed")
        .when(closed_by(status), "status")
        .when(closed_by(parent_status), "parent")
        .when(~sure((corrected | label.isin(*known)) & (F.length(label) <= longest)), "label")
        .otherwise("selectable")
    )
