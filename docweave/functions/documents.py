"""Document operators: on typed structs as columns (JVM side), and on plain JSON values for dynamic documents."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.naming import path_steps

# typed documents ---------------------------------------------------------------------------------


def merge_at(doc: Column, path: str, patch: dict[str, Column]) -> Column:
    """Shallow merge of fields into the object at a dotted path ('' for the document itself)."""
    for name, value in patch.items():
        doc = doc.withField(f"{path}.{name}" if path else name, value)
    return doc


def first_match(array: Column, key: str, value: Column) -> Column:
    """Index of the first element whose key equals the value; null without one."""
    at = F.array_position(F.transform(array, lambda e: e[key].eqNullSafe(value)), True)
    return F.when(at > 0, at - 1)


def patch_element(array: Column, key: str, value: Column, patch: dict[str, Column]) -> Column:
    """The first matching element merged with the patch; unchanged without a match."""
    at = first_match(array, key, value)
    return F.transform(array, lambda e, i: F.when(i.eqNullSafe(at), merge_at(e, "", patch)).otherwise(e))


def insert_element(array: Column, element: Column, sort_key: str | None = None, descending: bool = False) -> Column:
    """Appended, or in the order of ``sort_key`` with missing keys last; equal keys stay in their order of
    arrival. A null array is an empty one."""
    one = F.array(element)
    joined = F.when(array.isNull(), one).otherwise(F.concat(array, one))
    if sort_key is None:
        return joined
    sign = -1 if descending else 1
    numbered = F.transform(joined, lambda e, i: F.struct(e.alias("e"), i.alias("i")))

    def order(a: Column, b: Column) -> Column:
        x, y = a["e"][sort_key], b["e"][sort_key]
        tie = F.signum(a["i"] - b["i"]).cast("int")
        return F.when(x.isNull() & y.isNull(), tie).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, -sign).when(x > y, sign).otherwise(tie)

    return F.transform(F.array_sort(numbered, order), lambda s: s["e"])


def delete_elements(array: Column, key: str, value: Column) -> Column:
    return F.filter(array, lambda e: ~e[key].eqNullSafe(value))


def contains_element(array: Column, key: str, value: Column) -> Column:
    return F.coalesce(F.exists(array, lambda e: e[key].eqNullSafe(value)), F.lit(False))


def update_element_path(array: Column, key: str, value: Column, path: str, new: Column) -> Column:
    """The field at a dotted path inside the first matching element."""
    at = first_match(array, key, value)
    return F.transform(array, lambda e, i: F.when(i.eqNullSafe(at), e.withField(path, new)).otherwise(e))


def merge_elements(array: Column, key: str, updates: Column, fields: list[str]) -> Column:
    """Every element merged with the first update (a struct with ``fields``) of the same key; fields that an update
    has null are kept."""

    def merged(e: Column) -> Column:
        found = F.try_element_at(F.filter(updates, lambda u: u[key].eqNullSafe(e[key])), F.lit(1))
        for f in fields:
            e = e.withField(f, F.coalesce(found[f], e[f]))
        return e

    return F.transform(array, merged)


def update_elements(array: Column, key: str, updates: Column, field: str) -> Column:
    """Each element's ``field`` from the map ``updates`` of key to value, where it has the key."""
    return F.transform(array, lambda e: F.when(F.map_contains_key(updates, e[key]), e.withField(field, F.element_at(updates, e[key]))).otherwise(e))


def contains(doc: Column, wanted: dict[str, Column]) -> Column:
    """Containment: every wanted field equals."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & doc[name].eqNullSafe(value)
    return out


def to_text(doc: Column) -> Column:
    """JSON text with nulls kept."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


# dynamic documents: the same operators on JSON values ----------------------------------------------


def get_path(doc, path: str):
    for step in path_steps(path):
        try:
            doc = doc[step]
        except (KeyError, IndexError, TypeError):
            return None
    return doc


def set_path(doc, path: str, value):
    """A copy with the value at the path; objects on the way are made, siblings kept, arrays are not grown."""
    steps = path_steps(path)
    out = copy.deepcopy(doc) if isinstance(doc, dict) else {}
    at = out
    for step, after in zip(steps, steps[1:]):  # noqa: B905
        if isinstance(step, int):
            if not isinstance(at, list) or step >= len(at):
                return out
        elif not isinstance(at.get(step), dict if isinstance(after, str) else list):
            if isinstance(after, int):
                return out
            at[step] = {}
        at = at[step]
    if isinstance(steps[-1], int):
        if isinstance(at, list) and steps[-1] < len(at):
            at[steps[-1]] = value
    elif isinstance(at, dict):
        at[steps[-1]] = value
    return out


def same(a, b) -> bool:
    """Typed equality: 1 is not "1" and not true."""
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def patch_scalar(doc: dict, patch: dict) -> dict:
    return {**(doc or {}), **(patch or {})}


def patch_nested(doc: dict, patch: dict, path: str) -> dict:
    found = get_path(doc, path)
    return set_path(doc, path, patch_scalar(found if isinstance(found, dict) else {}, patch))


def patch_array(doc: dict, patch: dict, path: str, key: str = "id", value=None) -> dict:
    """The first element whose key equals the patch's (or ``value``) merged with the patch."""
    array = get_path(doc, path)
    wanted = (patch or {}).get(key) if value is None else value
    if not isinstance(array, list):
        return doc
    for i, e in enumerate(array):
        if isinstance(e, dict) and key in e and same(e[key], wanted):
            return set_path(doc, path, [*array[:i], patch_scalar(e, patch), *array[i + 1 :]])
    return doc


def array_insert(doc: dict, path: str, element, sort_key: str | None = None, descending: bool = False) -> dict:
    array = get_path(doc, path)
    array = [*(array if isinstance(array, list) else []), element]
    if sort_key is not None:
        keyed = [e for e in array if e.get(sort_key) is not None]
        array = sorted(keyed, key=lambda e: e[sort_key], reverse=descending) + [e for e in array if e.get(sort_key) is None]
    return set_path(doc, path, array)


def array_delete(doc: dict, path: str, key: str, value) -> dict:
    array = get_path(doc, path)
    return set_path(doc, path, [e for e in array if not same(e.get(key), value)]) if isinstance(array, list) else doc


def array_contains(doc: dict, path: str, key: str, value) -> bool:
    array = get_path(doc, path)
    return isinstance(array, list) and any(isinstance(e, dict) and key in e and same(e[key], value) for e in array)


def array_update_path(doc: dict, array: str, key: str, value, path: str, new) -> dict:
    found = get_path(doc, array)
    for i, e in enumerate(found if isinstance(found, list) else []):
        if isinstance(e, dict) and same(e.get(key), value):
            return set_path(doc, array, [*found[:i], set_path(e, path, new), *found[i + 1 :]])
    return doc


def array_update_batch(doc: dict, array: str, key: str, updates: list[dict]) -> dict:
    for u in updates or []:
        doc = patch_array(doc, u, array, key)
    return doc


def extract_id(doc: dict, key: str = "id") -> str | None:
    value = (doc or {}).get(key)
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def on_json(operator: Callable, *args, returns: str = "string") -> Callable[[Column], Column]:
    """An Arrow-batched function that applies a dynamic operator to JSON text; null stays null."""

    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            value = operator(json.loads(text), *args)
            return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if returns == "string" and not isinstance(value, str) else value

        return texts.map(one, na_action="ignore") if len(texts) else texts

    return run


def set_path_json(texts: Column, path: str, value: Column) -> Column:
    """JSON text with a text value put at a path, in one Arrow-batched pass; null text stays null."""
    path_steps(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        made = [None if d is None else json.dumps(set_path(json.loads(d), path, None if v is None else v), ensure_ascii=False, separators=(",", ":")) for d, v in zip(docs, values, strict=True)]
        return pd.Series(made, dtype=object)

    return run(texts, value)


def key_exists(texts: Column, key: str) -> Column:
    """Whether the object of a JSON text has the key, its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(texts), key), F.lit(False))


def type_of_json(texts: Column) -> Column:
    """object, array, string, number, boolean or null, as JSON names types."""
    first = F.substring(F.ltrim(texts), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


# other names of the same operators -----------------------------------------------------------------

merge_shallow, merge_at_path, array_update_where, array_update_multi_row = patch_scalar, patch_nested, patch_array, array_update_batch
extract_jsonb_id, check_array_element_exists, update_array_element_path, update_array_elements_batch, update_single_path = extract_id, array_contains, array_update_path, array_update_batch, set_path


def checked(operator: Callable, *args) -> Callable:
    """An operator whose text arguments that name paths and keys are refused unless they are plain."""
    for a in args:
        path_steps(a)
    return lambda doc, *rest: operator(doc, *args, *rest)
