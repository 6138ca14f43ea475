"""Reading one value out of an artifact: the text as written, or a cause."""

from __future__ import annotations

import csv
import io
import json
import re
from html import unescape

NO_BINDING, AMBIGUOUS, UNPARSEABLE, INVALID = "NO_BINDING", "AMBIGUOUS_BINDING", "UNPARSEABLE_VALUE", "BINDING_INVALID"


class _Number(str):
    """A JSON number as it is written."""


class _Repeated(Exception):
    pass


def _once(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise _Repeated
    return dict(pairs)


def _refuse(name: str):
    raise ValueError(name)


def load_json(data: bytes):
    """JSON with numbers verbatim; a repeated key raises _Repeated, NaN and infinities ValueError."""
    return json.loads(data.decode("utf-8"), parse_int=_Number, parse_float=_Number, parse_constant=_refuse, object_pairs_hook=_once)


def walk(value, pointer: str):
    """The value at an RFC 6901 pointer; KeyError if there is none."""
    if pointer == "":
        return value
    if not pointer.startswith("/"):
        raise KeyError(pointer)
    for part in pointer[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value[part]
        elif isinstance(value, list):
            if not re.fullmatch(r"0|[1-9][0-9]*", part) or int(part) >= len(value):
                raise KeyError(part)
            value = value[int(part)]
        else:
            raise KeyError(part)
    return value


def _leaf(value) -> tuple[str | None, str | None]:
    if isinstance(value, str):
        return str(value).strip(), None
    return None, UNPARSEABLE


def json_pointer(data: bytes, pointer: str):
    try:
        return _leaf(walk(load_json(data), pointer))
    except _Repeated:
        return None, AMBIGUOUS
    except (KeyError, IndexError):
        return None, NO_BINDING
    except ValueError:
        return None, UNPARSEABLE


def stdout_regex(data: bytes, pattern: str):
    try:
        found = list(re.finditer(pattern, data.decode("utf-8", "replace")))
    except re.error:
        return None, INVALID
    if len(found) != 1:
        return None, AMBIGUOUS if found else NO_BINDING
    return (found[0][1].strip(), None) if found[0].re.groups and found[0][1] is not None else (None, INVALID)


def csv_cell(data: bytes, column: str, key: str, value: str):
    try:
        rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    except (UnicodeDecodeError, csv.Error):
        return None, UNPARSEABLE
    names = [x.strip() for x in rows[0]] if rows else []
    if names.count(column) > 1 or names.count(key) > 1:
        return None, AMBIGUOUS
    if column not in names or key not in names:
        return None, NO_BINDING
    at, by = names.index(column), names.index(key)
    hits = [r for r in rows[1:] if len(r) > by and r[by].strip() == value]
    if len(hits) != 1:
        return None, AMBIGUOUS if hits else NO_BINDING
    return (hits[0][at].strip(), None) if len(hits[0]) > at else (None, NO_BINDING)


def html_cell(html: str, row: int, column: int):
    rows = [r for r in re.findall(r"<tr\b.*?(?=<tr\b|</table|\Z)", html, re.S | re.I) if re.search(r"<td\b", r, re.I)]
    if row >= len(rows):
        return None, NO_BINDING
    cells = re.findall(r"<td\b[^>]*>(.*?)</td\s*>", rows[row], re.S | re.I)
    if column >= len(cells):
        return None, NO_BINDING
    return unescape(re.sub(r"<[^>]*>", "", cells[column])).strip(), None


def notebook_cell(data: bytes, pointer: str, row: int | None, column: int | None):
    """The leaf of a cell's outputs; keys may hold slashes: a key that is the rest of the pointer wins."""
    try:
        value = load_json(data)
    except _Repeated:
        return None, AMBIGUOUS
    except ValueError:
        return None, UNPARSEABLE
    rest = pointer[1:] if pointer.startswith("/") else pointer
    try:
        while rest:
            if isinstance(value, dict):
                key = next((k for k in sorted(value, key=len, reverse=True) if rest == k or rest.startswith(k + "/")), None)
                if key is None:
                    return None, NO_BINDING
                value, rest = value[key], rest[len(key) + 1 :]
            else:
                part, _, rest = rest.partition("/")
                value = walk(value, f"/{part}")
    except KeyError:
        return None, NO_BINDING
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        value = "".join(value)
    if row is not None and isinstance(value, str):
        return html_cell(value, row, column or 0)
    return _leaf(value)


def locate(kind: str, data: bytes | None, spec: dict):
    """(text, cause) of a locator: kind, the artifact's bytes, and the locator's fields."""
    if data is None:
        return None, NO_BINDING
    if kind == "json_pointer":
        return json_pointer(data, spec.get("pointer") or "")
    if kind == "stdout_regex":
        return stdout_regex(data, spec.get("pattern") or "")
    if kind == "csv_cell":
        return csv_cell(data, spec.get("column") or "", spec.get("row_key") or "", spec.get("row_value") or "")
    if kind == "notebook_cell":
        return notebook_cell(data, spec.get("pointer") or "", spec.get("table_row"), spec.get("table_column"))
    return None, INVALID
