"""JSON schemas as column expressions: a schema is compiled once, a row's JSON is parsed once to a variant, and the variant is walked by type.

References are resolved when a schema is compiled, so one that contains itself is refused, as is every keyword that isn't known here: a contract is checked whole or not at all.
"""

from __future__ import annotations

import json
import re
from functools import partial, reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsonc
from ..functions.jsonc import let

ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
TEXT = {"pattern", "minLength", "maxLength"}
NUMBER = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"}
ARRAY = {"items", "minItems", "maxItems", "uniqueItems"}
OBJECT = {"properties", "required", "additionalProperties", "propertyNames", "minProperties", "maxProperties"}
CHOICE = {"oneOf", "anyOf", "allOf", "not"}
KNOWN = ANNOTATIONS | TEXT | NUMBER | ARRAY | OBJECT | CHOICE | {"type", "const", "enum", "$ref"}
NAMES = {"pattern": lambda k, x: k.rlike(java_pattern(x)), "minLength": lambda k, x: F.char_length(k) >= x, "maxLength": lambda k, x: F.char_length(k) <= x, "enum": lambda k, x: k.isin(*x), "const": lambda k, x: k == x}  # of propertyNames
_NUMERIC = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def _none() -> Column:
    return F.array().cast("array<string>")


def java_pattern(pattern: str) -> str:
    """A pattern of JSON schema for Java: ``$`` is the very end there, not also the place before a last line break."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append("\\z" if c == "$" and not inside else c)
        k += 1
    return "".join(out)


def _chosen(word: str, said: Column, each: Column) -> Column:
    """Nothing if one of the branches fits (``oneOf``: exactly one), else what speaks against each, and the keyword."""
    n = F.size(F.filter(each, lambda e: F.size(e) == 0))
    return F.when(n == 1 if word == "oneOf" else n >= 1, _none()).otherwise(F.array_append(F.flatten(each), said))


def _held(ok, expected, key: Column) -> Column:
    return ok(key, expected)


class Schema:
    """A compiled schema. ``root`` may hold ``$defs`` that references point into; ``at`` names the part to start from, such as ``#/$defs/claim``."""

    def __init__(self, root: dict, at: str = "#"):
        self.root = root
        self.start = self._resolved({"$ref": at} if at != "#" else root, ())

    def _target(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise ValueError(f"a reference out of the schema: {ref}")
        node = self.root
        for name in ref.removeprefix("#").split("/")[1:]:
            name = name.replace("~1", "/").replace("~0", "~")
            if not isinstance(node, dict) or name not in node:
                raise ValueError(f"a reference to nothing: {ref}")
            node = node[name]
        return node

    def _resolved(self, s: dict | bool, seen: tuple[str, ...]) -> dict | bool:
        """The schema without references, all keywords known."""
        if isinstance(s, bool):
            return s
        if unknown := set(s) - KNOWN:
            raise ValueError(f"unknown keywords: {sorted(unknown)}")
        if "$ref" in s:
            if s["$ref"] in seen:
                raise ValueError(f"a schema that contains itself: {s['$ref']}")
            target = self._resolved(self._target(s["$ref"]), (*seen, s["$ref"]))
            rest = {k: v for k, v in s.items() if k != "$ref" and k not in ANNOTATIONS}
            return {"allOf": [target, self._resolved(rest, seen)]} if rest else target
        out = {k: v for k, v in s.items() if k not in ANNOTATIONS}
        for k in ("items", "additionalProperties", "not"):
            if k in out:
                out[k] = self._resolved(out[k], seen)
        if "properties" in out:
            out["properties"] = {k: self._resolved(v, seen) for k, v in out["properties"].items()}
        for k in ("oneOf", "anyOf", "allOf"):
            if k in out:
                out[k] = [self._resolved(v, seen) for v in out[k]]
        if "propertyNames" in out:
            names = out["propertyNames"] = self._resolved(out["propertyNames"], seen)
            if isinstance(names, bool) or set(names) - TEXT - {"type", "enum", "const"}:
                raise ValueError("propertyNames: a pattern, lengths, and fixed names are known")
        return out

    def violations(self, value: Column) -> Column:
        """What of a JSON text breaks the schema: sorted, different ``path:keyword`` entries, ``$:json`` alone for null and for what is no JSON or repeats a key.

        Paths are ``$``, ``.name`` (``['name']`` where it has other than letters, digits and ``_``) and ``[0]``. A key that is absent breaks only ``required``, said of the object with the key's name behind it.
        Equal values are equal as JSON: 1 and 1.0 are, 1 and "1" are not, and whole numbers are integers however written. Where none or several of ``oneOf`` fit, what speaks against each is said too.
        """
        return let(F.try_parse_json(value), lambda v: F.when(v.isNull(), F.array(F.lit("$:json"))).otherwise(F.array_sort(F.array_distinct(self._broken(self.start, v, ("$",))))))

    def holds(self, v: Column) -> Column:
        """Whether the variant of a JSON text, a column that is there, has no ``violations``. None are listed: parts are read by their paths, in generated code."""
        return v.isNotNull() & self._fits(self.start, v, "$")

    def _fits(self, s: dict | bool, v: Column, path: str) -> Column:
        """Whether what stands at a path of a variant, and is there, has no violations."""
        if isinstance(s, bool):
            return F.lit(s)
        got = lambda kind: F.try_variant_get(v, path, kind)
        kind = F.schema_of_variant(got("variant"))
        text, number, as_map, as_list = got("string"), got("double"), got("map<string,variant>"), got("array<variant>")
        is_text, is_number = kind == "STRING", F.regexp_extract(kind, "^[A-Z]+", 0).isin(*_NUMERIC)
        good: list[Column] = []
        bad = lambda when: good.append(~F.coalesce(when, F.lit(False)))
        if "type" in s:
            of = {"string": is_text, "number": is_number, "integer": is_number & (number == F.floor(number)), "boolean": kind == "BOOLEAN", "null": kind == "VOID", "object": as_map.isNotNull(), "array": as_list.isNotNull()}
            bad(~reduce(or_, [of[n] for n in ([s["type"]] if isinstance(s["type"], str) else s["type"])]))
        for word in ("const", "enum"):
            if word in s:
                bad(~self._among([s[word]] if word == "const" else s[word], got("variant"), text, number, is_text, is_number))
        for word, over in (("pattern", lambda x: ~text.rlike(java_pattern(x))), ("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x)):
            if word in s:
                bad(over(s[word]) if s.get("type") == "string" else is_text & over(s[word]))
        for word, over in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x)):
            if word in s:
                bad(is_number & over(float(s[word])))
        if ARRAY & set(s):
            for word, over in (("minItems", lambda x: F.size(as_list) < x), ("maxItems", lambda x: F.size(as_list) > x)):
                if word in s:
                    bad(as_list.isNotNull() & over(s[word]))
            if s.get("uniqueItems"):
                bad(F.size(F.array_distinct(F.transform(as_list, jsonc.canonical_variant))) < F.size(as_list))
            if "items" in s:
                bad(~F.forall(as_list, lambda x: self._fits(s["items"], x, "$")))
        if OBJECT & set(s):
            self._fits_object(s, v, path, as_map, bad)
        good += [self._fits(one, v, path) for one in s.get("allOf", ())]
        if "anyOf" in s:
            good.append(reduce(or_, [self._fits(one, v, path) for one in s["anyOf"]]))
        if "oneOf" in s:
            good.append(reduce(add, [self._fits(one, v, path).cast("int") for one in s["oneOf"]]) == 1)
        if "not" in s:
            good.append(~self._fits(s["not"], v, path))
        return reduce(and_, good, F.lit(True))

    def _fits_object(self, s: dict, v: Column, path: str, m: Column, bad) -> None:
        """What ``properties`` and the like demand of a node, where it is an object."""
        keys, known, is_map = F.map_keys(m), s.get("properties", {}), m.isNotNull()

        def inner(name: str) -> tuple[Column, str]:
            quote = '"' if "'" in name else "'"
            return (F.try_element_at(m, F.lit(name)), "$") if quote in name or "\\" in name else (v, f"{path}[{quote}{name}{quote}]")

        there = lambda name: F.try_variant_get(*inner(name), "variant").isNotNull()
        for name in s.get("required", ()):
            bad(is_map & ~there(name))
        for word, over in (("minProperties", lambda x: F.size(keys) < x), ("maxProperties", lambda x: F.size(keys) > x)):
            if word in s:
                bad(is_map & over(s[word]))
        more = s.get("additionalProperties")
        if more is False:
            bad(is_map & (F.size(keys) > reduce(add, [there(name).cast("int") for name in known], F.lit(0))))
        elif isinstance(more, dict):
            rest = F.map_filter(m, lambda k, _: ~k.isin(*known)) if known else m
            bad(~F.forall(F.map_values(rest), lambda x: self._fits(more, x, "$")))
        names = s.get("propertyNames", True)
        if names is not True:
            for word, ok in NAMES.items():
                if word in names:
                    bad(~F.forall(keys, partial(_held, ok, names[word])))
        for name in sorted(known, key=lambda n: not (isinstance(known[n], dict) and "const" in known[n])):
            bad(there(name) & ~self._fits(known[name], *inner(name)))

    def _broken(self, s: dict | bool, v: Column, path: tuple) -> Column:
        """The violations of a variant that is there."""
        if s is True or s == {}:
            return _none()
        say = lambda word: F.lit("".join(path) + f":{word}") if all(isinstance(p, str) for p in path) else F.concat(*(F.lit(p) if isinstance(p, str) else p for p in path), F.lit(f":{word}"))
        if s is False:
            return F.array(say("false"))
        if s.get("type") == "string" and not (NUMBER | ARRAY | OBJECT | CHOICE) & set(s):
            return let(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), partial(self._text, s, say))
        plain: list[Column] = []  # a text or null each
        parts: list[Column] = []  # an array each
        bad = lambda when, word: plain.append(F.when(F.coalesce(when, F.lit(False)), say(word)))
        kind = F.schema_of_variant(v)
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        is_text, is_number = kind == "STRING", F.regexp_extract(kind, "^[A-Z]+", 0).isin(*_NUMERIC)
        as_map, as_list = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
        if "type" in s:
            names = s["type"] if isinstance(s["type"], list) else [s["type"]]
            of = {"string": is_text, "number": is_number, "integer": is_number & (number == F.floor(number)), "boolean": kind == "BOOLEAN", "null": kind == "VOID", "object": as_map.isNotNull(), "array": as_list.isNotNull()}
            good = of[names[0]]
            for n in names[1:]:
                good = good | of[n]
            bad(~good, "type")
        for word in ("const", "enum"):
            if word in s:
                bad(~self._among([s[word]] if word == "const" else s[word], v, text, number, is_text, is_number), word)
        if "pattern" in s:
            bad(is_text & ~text.rlike(java_pattern(s["pattern"])), "pattern")
        if "minLength" in s:
            bad(is_text & (F.char_length(text) < s["minLength"]), "minLength")
        if "maxLength" in s:
            bad(is_text & (F.char_length(text) > s["maxLength"]), "maxLength")
        for word, over in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x)):
            if word in s:
                bad(is_number & over(float(s[word])), word)
        if ARRAY & set(s):
            parts.append(F.coalesce(let(as_list, lambda a: self._list(s, a, path, say)), _none()))
        if OBJECT & set(s):
            parts.append(F.coalesce(let(as_map, lambda m: self._object(s, m, path, say)), _none()))
        for one in s.get("allOf", ()):
            parts.append(self._broken(one, v, path))
        for word in ("oneOf", "anyOf"):
            if word in s:
                parts.append(let(F.array(*(self._broken(one, v, path) for one in s[word])), partial(_chosen, word, say(word))))
        if "not" in s:
            bad(F.size(self._broken(s["not"], v, path)) == 0, "not")
        return F.concat(*([F.array_compact(F.array(*plain))] if plain else []), *parts) if plain or parts else _none()

    def _text(self, s: dict, say, text: Column) -> Column:
        """Of a node that has to be a string, null if it is none."""
        bad = []
        if fixed := [x for x in s.get("enum", [s["const"]] if "const" in s else []) if isinstance(x, str)] or {"enum", "const"} & set(s):
            bad.append(("enum" if "enum" in s else "const", ~text.isin(*fixed) if isinstance(fixed, list) else F.lit(True)))
        if "pattern" in s:
            bad.append(("pattern", ~text.rlike(java_pattern(s["pattern"]))))
        if "minLength" in s:
            bad.append(("minLength", F.char_length(text) < s["minLength"]))
        if "maxLength" in s:
            bad.append(("maxLength", F.char_length(text) > s["maxLength"]))
        return F.when(text.isNull(), F.array(say("type"), *(say(w) for w, _ in bad if w in ("enum", "const")))).otherwise(F.array_compact(F.array(*(F.when(b, say(w)) for w, b in bad))) if bad else _none())

    def _if_there(self, s: dict | bool, path: tuple, v: Column) -> Column:
        return F.when(v.isNotNull(), self._broken(s, v, path)).otherwise(_none())

    def _among(self, values: list, v: Column, text: Column, number: Column, is_text: Column, is_number: Column) -> Column:
        """Whether the value equals one of the given."""
        texts, numbers = [x for x in values if isinstance(x, str)], [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
        rest = [json.dumps(x, ensure_ascii=False) for x in values if isinstance(x, (bool, list, dict)) or x is None]
        good = is_text & text.isin(*texts) if texts else F.lit(False)
        if numbers:
            good = good | is_number & number.isin(*numbers)
        if rest:
            good = good | jsonc.canonical_variant(v).isin(*rest) if all(x in ("true", "false", "null") for x in rest) else good | F.array_contains(F.array(*(jsonc.canonical(F.lit(x)) for x in rest)), jsonc.canonical_variant(v))
        return F.coalesce(good, F.lit(False))

    def _list(self, s: dict, a: Column, path: tuple, say) -> Column:
        plain, n = [], F.size(a)
        if "minItems" in s:
            plain.append(F.when(n < s["minItems"], say("minItems")))
        if "maxItems" in s:
            plain.append(F.when(n > s["maxItems"], say("maxItems")))
        if s.get("uniqueItems"):
            plain.append(F.when(F.size(F.array_distinct(F.transform(a, jsonc.canonical_variant))) < n, say("uniqueItems")))
        own = F.array_compact(F.array(*plain)) if plain else _none()
        if "items" in s:
            own = F.concat(own, F.flatten(F.transform(a, lambda x, i: self._broken(s["items"], x, (*path, "[", i.cast("string"), "]")))))
        return F.when(a.isNotNull(), own)

    def _object(self, s: dict, m: Column, path: tuple, say) -> Column:
        keys, plain, parts, known = F.map_keys(m), [], [], s.get("properties", {})
        for name in s.get("required", ()):
            plain.append(F.when(~F.array_contains(keys, name), say(f"required:{name}")))
        if "minProperties" in s:
            plain.append(F.when(F.size(keys) < s["minProperties"], say("minProperties")))
        if "maxProperties" in s:
            plain.append(F.when(F.size(keys) > s["maxProperties"], say("maxProperties")))
        other = F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))
        if s.get("additionalProperties") is False:
            plain.append(F.when(F.size(other) > 0, say("additionalProperties")))
        elif isinstance(s.get("additionalProperties"), dict):
            parts.append(F.flatten(F.transform(other, lambda k: let(F.try_element_at(m, k), lambda x: self._broken(s["additionalProperties"], x, (*path, "['", k, "']"))))))
        if "propertyNames" in s:
            names, good = s["propertyNames"], []
            for word, ok in NAMES.items():
                if word in names:
                    good.append((ok, names[word]))
            for ok, x in good:
                plain.append(F.when(~F.forall(keys, partial(_held, ok, x)), say("propertyNames")))
        for name, inner in known.items():
            at = (*path, f".{name}" if re.fullmatch(r"\w+", name, re.A) else f"['{name}']")
            parts.append(let(F.try_element_at(m, F.lit(name)), partial(self._if_there, inner, at)))
        return F.when(m.isNotNull(), F.concat(*([F.array_compact(F.array(*plain))] if plain else []), *parts) if plain or parts else _none())
