"""Strict JSON reading that keeps how numbers were written and has no depth limit."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


class Whole(str):
    """A number written without point and exponent, as its text."""


class Fraction(str):
    """A number written with a point or exponent, as its text."""


def _refuse(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(parse_int=Whole, parse_float=Fraction, parse_constant=_refuse)


def read(text: str | None):
    """The value of a JSON text; ValueError where it is null or not valid JSON.

    NaN and Infinity are not JSON. Of equal keys in one object the last counts.
    """
    if text is None:
        raise ValueError("null")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str):
    """The same without recursion, for texts nested thousands of levels deep."""
    skip = lambda at: _SPACE.match(text, at).end()
    open_: list = []  # containers not yet closed
    keys: list[str] = []  # for each open object its current key
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c == "{" or c == "[":
            at = skip(at + 1)
            new: dict | list = {} if c == "{" else []
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = new, at + 1
            else:
                open_.append(new)
                if c == "{":
                    key, at = _key(text, at, skip)
                    keys.append(key)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (Fraction if m[1] or m[2] else Whole)(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at = _WORDS[word], at + len(word)
        while True:  # the value is complete: hand it to its container
            at = skip(at)
            if not open_:
                if at != len(text):
                    raise ValueError(f"extra text at {at}")
                return value
            box, c = open_[-1], text[at : at + 1]
            if isinstance(box, dict):
                box[keys[-1]] = value
                if c == ",":
                    keys[-1], at = _key(text, skip(at + 1), skip)
                    break
                if c != "}":
                    raise ValueError(f"no end of object at {at}")
                keys.pop()
            else:
                box.append(value)
                if c == ",":
                    at = skip(at + 1)
                    break
                if c != "]":
                    raise ValueError(f"no end of array at {at}")
            value, at = open_.pop(), at + 1


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, skip(at + 1)


def kind(value) -> str:
    """null, string, whole, fraction, boolean, object or array."""
    if value is None:
        return "null"
    t = type(value)
    if t is Whole:
        return "whole"
    if t is Fraction:
        return "fraction"
    if t is bool:
        return "boolean"
    if t is dict:
        return "object"
    return "array" if t is list else "string"


def clean(s: str) -> str:
    """Without lone surrogates."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def dump(value) -> str:
    """Compact JSON with sorted keys; numbers as they were written."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        t = type(v)
        if t is tuple:
            out.append(v[0])
        elif t is Whole or t is Fraction:
            out.append(str(v))
        elif t is dict:
            out.append("{")
            rest: list = []
            for i, k in enumerate(sorted(v)):
                rest += [(("," if i else "") + json.dumps(clean(k), ensure_ascii=False) + ":",), v[k]]
            todo += reversed([*rest, ("}",)])
        elif t is list:
            out.append("[")
            rest = []
            for i, x in enumerate(v):
                rest += [(",",), x] if i else [x]
            todo += reversed([*rest, ("]",)])
        else:
            out.append(json.dumps(clean(v) if t is str else v, ensure_ascii=False))
    return "".join(out)
