"""Strict JSON: why a text is refused, and its canonical form.

Built-in parsers accept what the formats refuse (depth, lone surrogates, which
error comes first), so this walks the text in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from basalt.plans.limits import JSON_DEPTH, METADATA_BYTES, PLAINTEXT_BYTES, V2

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])|(true|false|null)(?!\w)|(//|/\*)|$)')


class Refused(ValueError):
    pass


def _scan(text: str, depth_limit: int):
    """Values and structure, stopping at the first error."""
    if not text:
        raise Refused("empty")
    at, stack, value, last, seen = 0, [], True, None, False
    while True:
        m = TOKEN.match(text, at)
        if not m or (m.end() == len(text) and not any(m.groups())):
            if m is None:
                raise Refused("trailing-token" if seen and not stack else "parse")
            if stack or not seen:
                raise Refused("parse" if seen or last or stack else "empty")
            return
        sign, string, number, word, comment = m.groups()
        if not m.group(0) and not any(m.groups()):
            raise Refused("parse")
        at = m.end()
        if comment:
            raise Refused("comment")
        if seen and not stack:
            raise Refused("trailing-token")
        top = stack[-1] if stack else None
        if sign in ("}", "]"):
            if not top or top[0] != ("{" if sign == "}" else "["):
                raise Refused("parse")
            if last == ",":
                raise Refused("trailing-comma")
            if last not in (top[0], "value"):
                raise Refused("parse")
            stack.pop()
            last = "value"
        elif sign == ",":
            if last != "value":
                raise Refused("parse")
            last = ","
        elif sign == ":":
            if last != "key":
                raise Refused("parse")
            last = ":"
        else:
            if last in ("value", "key"):
                raise Refused("parse")
            if top and top[0] == "{" and last != ":":
                if not string:
                    raise Refused("parse")
                key = json.loads(string)
                check_text(key)
                if key in top[1]:
                    raise Refused("duplicate-key")
                top[1].add(key)
                last = "key"
                continue
            if sign:
                if len(stack) >= depth_limit:
                    raise Refused("depth")
                stack.append((sign, set()))
                last = sign
                continue
            if string:
                check_text(json.loads(string))
            elif number and not math.isfinite(float(number)):
                raise Refused("non-finite")
            last = "value"
        seen = seen or last == "value"


def check_text(text: str) -> None:
    if any("\ud800" <= c <= "\udfff" for c in text):
        raise Refused("surrogate")


SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


class _Odd(Exception):
    """What the built-in parser reads and the walk has to look at."""


class _Reader:
    """The built-in parser, stopped at all that it is laxer about; ``plain`` tells that its own printer gives the canonical form."""

    def __init__(self) -> None:
        self.plain = True
        self.decoder = json.JSONDecoder(object_pairs_hook=self._object, parse_float=self._float, parse_int=self._int, parse_constant=self._constant)

    def _object(self, pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise _Odd
        return out

    def _float(self, token: str) -> float:
        self.plain = False
        x = float(token)
        if not math.isfinite(x):
            raise _Odd
        return x

    def _int(self, token: str) -> int:
        if len(token) > 15 or token == "-0":
            self.plain = False
            if not math.isfinite(float(token)):
                raise _Odd
        return int(token)

    def _constant(self, token: str):
        raise _Odd

    def read(self, text: str, depth: int):
        """The value of a text that is fine; anything else raises."""
        if SURROGATE.search(text):
            raise _Odd
        self.plain = text.isascii() or max(text) < "\U00010000"
        value = self.decoder.decode(text)
        if text.count("[") + text.count("{") > depth and _deeper(value, depth):
            raise _Odd
        return value


def _deeper(value, depth: int) -> bool:
    """Whether containers are nested in more than ``depth`` levels."""
    level = [value] if isinstance(value, (dict, list)) else []
    while level:
        depth -= 1
        if depth < 0:
            return True
        level = [x for c in level for x in (c.values() if isinstance(c, dict) else c) if isinstance(x, (dict, list))]
    return False


_reader = _Reader()
_print = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def parsed(data: bytes | None, most: int = PLAINTEXT_BYTES, depth: int = JSON_DEPTH) -> tuple[str | None, object, Callable[[object], str] | None]:
    """(class of the first error or None, value, what prints the value and its parts in canonical form).

    A text that the built-in parser reads, with nothing in it that is refused, is fine. Only others
    are walked, for the class of their first error.
    """
    if data is None:
        return "empty", None, None
    if len(data) > most:
        return "too-large", None, None
    if data.startswith(b"\xef\xbb\xbf"):
        return "bom", None, None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "utf-8", None, None
    try:
        value = _reader.read(text, depth)
    except (_Odd, ValueError, RecursionError):
        try:
            _scan(text, depth)
        except Refused as e:
            return str(e), None, None
        return None, json.loads(text), canonical
    return None, value, _print if _reader.plain else canonical


def read(data: bytes | None, most: int = PLAINTEXT_BYTES, depth: int = JSON_DEPTH) -> tuple[str | None, str | None]:
    """(class of the first error, canonical text); one of them is None."""
    found, value, text = parsed(data, most, depth)
    return found, text(value) if text else None


def refusal(data: bytes | None, most: int = PLAINTEXT_BYTES, depth: int = JSON_DEPTH) -> str | None:
    """The class of the first error, or None for a text that is fine."""
    return read(data, most, depth)[0]


def _number(x) -> str:
    """Numbers as ECMAScript prints doubles."""
    x = float(x)
    digits = repr(x)
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        plain = format(Decimal(digits), "f") if x else "0"
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    mantissa, _, exponent = digits.partition("e")
    return f"{mantissa.removesuffix('.0')}e{'+' if int(exponent) > 0 else '-'}{abs(int(exponent))}"


def canonical(value) -> str:
    """Canonical text: sorted keys (by UTF-16 units), no spaces, shortest numbers."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return _number(value) if isinstance(value, (int, float)) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StructType([T.StructField("refusal", T.StringType()), T.StructField("canonical", T.StringType())]))
def json_read(data: pd.Series) -> pd.DataFrame:
    """Why a text is refused, or its canonical form; each text is read once for both."""
    return pd.DataFrame([read(None if d is None else bytes(d), V2["plan_bytes"]) for d in data], columns=["refusal", "canonical"])


@F.arrow_udf(T.StructType([T.StructField("refusal", T.StringType()), T.StructField("same", T.BooleanType())]))
def json_state(data: pa.Array) -> pa.Array:
    """Why a text is refused, or whether it is its own canonical form.

    Texts are taken one at a time and none is given back, so a worker holds its batch and little else.
    """
    refusals, same = [], []
    for d in data:
        own = d.as_py()
        found, text = read(own, V2["plan_bytes"])
        refusals.append(found)
        same.append(text is not None and text.encode() == own)
    return pa.StructArray.from_arrays([pa.array(refusals, pa.string()), pa.array(same, pa.bool_())], ["refusal", "same"])


def _record(item, text: Callable[[object], str]) -> tuple[str | None, str | None, bool, str]:
    """kind, canonical body, whether there is nothing else, and canonical text of an item of an array of records."""
    if not isinstance(item, dict):
        return None, None, False, text(item)
    kind, body = item.get("recordKind"), text(item["body"]) if "body" in item else None
    closed = len(item) == 2 and body is not None and "recordKind" in item
    whole = f'{{"body":{body},"recordKind":{text(kind)}}}' if closed else text(item)
    if not isinstance(kind, str):
        kind = None if kind is None or isinstance(kind, (dict, list)) else text(kind)
    return kind, body, closed, whole


def _state_of_records(own: bytes | None, member: str | None) -> tuple[str | None, bool, list[tuple] | None]:
    """Why a text is refused, whether it is its own canonical form, and its records: its items, or those of its ``member``."""
    found, value, text = parsed(own, V2["plan_bytes"])
    if text is None:
        return found, False, None
    if member and isinstance(value, dict):
        items = value.get(member)
    else:
        items = None if member else value
    if not isinstance(items, list):
        return None, text(value).encode() == own, None
    records = [_record(x, text) for x in items]
    whole = f"[{','.join(x[3] for x in records)}]"
    if member:
        whole = "{" + ",".join(f"{text(k)}:{whole if k == member else text(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    return None, whole.encode() == own, records


RECORD = T.StructType([T.StructField("kind", T.StringType()), T.StructField("body", T.StringType()), T.StructField("closed", T.BooleanType())])
RECORDS = T.StructType([T.StructField("refusal", T.StringType()), T.StructField("same", T.BooleanType()), T.StructField("records", T.ArrayType(RECORD))])


def _rows(found: list[tuple]) -> pa.Array:
    """What ``_state_of_records`` gives of each text, as rows of ``RECORDS``."""
    at, flat = [], []
    for _, _, records in found:
        at.append(None if records is None else len(flat))
        flat += records or ()
    column = lambda i, type_: pa.array([x[i] for x in flat], type_)
    each = pa.StructArray.from_arrays([column(0, pa.string()), column(1, pa.string()), column(2, pa.bool_())], ["kind", "body", "closed"])
    records = pa.ListArray.from_arrays(pa.array([*at, len(flat)], pa.int32()), each)
    return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_()), records], ["refusal", "same", "records"])


def _walk(member: str | None):
    @F.arrow_udf(RECORDS)
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, size = [], 0
            for d in batch:
                own = d.as_py()
                found.append(_state_of_records(own, member))
                size += len(own or b"")
                # records go back as they come, so a worker holds its batch and the records of a few texts
                if size > 1 << 20:
                    yield _rows(found)
                    found, size = [], 0
            if found:
                yield _rows(found)

    return walk


#: Why a text is refused, whether it is its own canonical form, and its records (kind, canonical body, closed: nothing else), in one walk;
#: records are null where there is no array of them. An array of records, and a shard node.
array_records, shard_records = _walk(None), _walk("records")


CLAIM = T.StructType([T.StructField(f, T.StringType()) for f in ("kind", "identity", "package", "body")])
#: What a catalog says of itself (null where it isn't told by a value of the right type) and its records: its entries, then its observations.
CATALOG = T.StructType(
    [
        T.StructField("refusal", T.StringType()),
        T.StructField("digest", T.StringType()),  # of its canonical form
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("version", T.LongType()),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("entries", T.IntegerType()),
        T.StructField("observations", T.IntegerType()),
        T.StructField("observed", T.IntegerType()),  # different observations
        T.StructField("locators", T.IntegerType()),  # most of an entry
        T.StructField("metadata", T.IntegerType()),  # bytes, most of an entry; 0 if all entries are shorter than metadata may be
        T.StructField("repeats", T.BooleanType()),  # whether an identity comes twice
        T.StructField("records", T.ArrayType(CLAIM)),
    ]
)


_MARK = uuid.uuid4().hex
_BETWEEN = f',"{_MARK}",'


def _printed(items: list, text: Callable[[object], str]) -> list[str]:
    """Canonical texts of items. Small ones take as long for each call of the printer as for what is printed, so they are printed in one go, with marks between."""
    if text is not _print or len(items) < 2:
        return [text(x) for x in items]
    marked = [_MARK] * (2 * len(items) - 1)
    marked[::2] = items
    out = text(marked)[1:-1].split(_BETWEEN)
    return out if len(out) == len(items) else [text(x) for x in items]  # a text that holds the mark itself


def _told(x, text: Callable[[object], str]) -> str | None:
    """A string as it is, null for null, another value as its text."""
    return x if x is None or isinstance(x, str) else text(x)


def _identity(entry: dict):
    package = entry.get("package")
    for found in (package.get("sha256") if isinstance(package, dict) else None, entry.get("eventId"), entry.get("receiptId")):
        if found is not None:
            return found
    return None


def _entry(x, text: Callable[[object], str]) -> tuple[str | None, str | None, str | None]:
    """kind, identity, and the package that a tombstone is about."""
    if not isinstance(x, dict):
        return None, None, None
    kind = x.get("entryKind")
    return _told(kind, text), _told(_identity(x), text), _told(x.get("targetPackageSha256"), text) if kind == "tombstone" else None


def _observation(x, text: Callable[[object], str]) -> tuple[str | None, str | None, str | None]:
    return ("observation", _told(x.get("observationId"), text), _told(x.get("packageSha256"), text)) if isinstance(x, dict) else ("observation", None, None)


def _catalog(own: bytes | None) -> dict:
    """What ``CATALOG`` tells of a text."""
    found, value, text = parsed(own, V2["plan_bytes"])
    if text is None:
        return {"refusal": found}
    if not isinstance(value, dict):
        return {"digest": hashlib.sha256(text(value).encode()).hexdigest()}
    out, keys, bodies, whole = {"fields": list(value)}, [], [], {}
    for field, key in (("entries", _entry), ("observations", _observation)):
        items = value.get(field)
        if isinstance(items, list):
            made = _printed(items, text)
            out[field], whole[field] = len(made), f"[{','.join(made)}]"
            bodies += made
            keys += [key(x, text) for x in items]
    if "entries" in out:
        held = [x for x in value["entries"] if isinstance(x, dict)]
        out["locators"] = max((len(x["locators"]) for x in held if isinstance(x.get("locators"), list)), default=0)
        # where no entry is as long as metadata may be, none has to be printed for its length
        large = held if any(4 * len(body) > METADATA_BYTES for body in bodies[: out["entries"]]) else ()
        out["metadata"] = max((len(text(x["metadata"]).encode()) for x in large if x.get("metadata") is not None), default=0)
    if "observations" in out:
        out["observed"] = len({x[1] for x in keys[out.get("entries", 0) :]})
    version, parents = value.get("payloadVersion"), value.get("parents")
    if type(version) is int and abs(version) < 1 << 63:
        out["version"] = version
    if isinstance(parents, list):
        out["parents"] = [x if isinstance(x, str) else None for x in parents]
    out["repeats"] = len({x[:2] for x in keys}) < len(keys)
    names = sorted(value, key=lambda k: k.encode("utf-16-be"))
    canon = "{" + ",".join([f"{text(k)}:{whole.get(k) or text(value[k])}" for k in names]) + "}"
    return out | {"digest": hashlib.sha256(canon.encode()).hexdigest(), "records": [(*k, body) for k, body in zip(keys, bodies, strict=True)]}


def _listed(all_: list[list | None], flat: Callable[[list], pa.Array]) -> pa.Array:
    at, items = [], []
    for own in all_:
        at.append(None if own is None else len(items))
        items += own or ()
    return pa.ListArray.from_arrays(pa.array([*at, len(items)], pa.int32()), flat(items))


def _catalogs(found: list[dict]) -> pa.Array:
    """What ``_catalog`` gives of each text, as rows of ``CATALOG``."""
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}
    claims = lambda items: pa.StructArray.from_arrays([pa.array([x[i] for x in items], pa.string()) for i in range(4)], CLAIM.names)
    columns = []
    for f in CATALOG.fields:
        own = [x.get(f.name) for x in found]
        if isinstance(f.dataType, T.ArrayType):
            columns.append(_listed(own, claims if f.name == "records" else lambda items: pa.array(items, pa.string())))
        else:
            columns.append(pa.array(own, kinds[f.dataType]))
    return pa.StructArray.from_arrays(columns, CATALOG.names)


@F.arrow_udf(CATALOG)
def catalog_records(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What a catalog says of itself and its records, in one walk."""
    for batch in batches:
        found, size = [], 0
        for d in batch:
            own = d.as_py()
            found.append(_catalog(own))
            size += len(own or b"")
            # records go back as they come, so a worker holds its batch and the records of a few texts
            if size > 1 << 20:
                yield _catalogs(found)
                found, size = [], 0
        if found:
            yield _catalogs(found)


def json_refusal(data: Column | str, most: int = PLAINTEXT_BYTES) -> Column:
    return F.when(F.octet_length(data) > most, "too-large").otherwise(json_read(data)["refusal"])


def json_canonical(data: Column | str) -> Column:
    """Null for refused texts."""
    return json_read(data)["canonical"]


def is_canonical(data: Column) -> Column:
    return F.coalesce(json_canonical(data) == data.cast("string"), F.lit(False))


def is_decimal_one(token: str, most: int = 64) -> bool:
    """A number token whose exact value is 1, whatever its form."""
    if len(token) > most or not re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", token):
        return False
    mantissa, _, exponent = token.lower().partition("e")
    if exponent and abs(int(exponent)) > most:
        return False
    try:
        return Decimal(mantissa).scaleb(int(exponent or 0)) == 1
    except InvalidOperation:
        return False


@F.pandas_udf(T.BooleanType())
def decimal_one(token: pd.Series) -> pd.Series:
    return token.map(lambda t: t is not None and is_decimal_one(t))


def _member_tokens(text: str, path: tuple[str, ...]) -> list[str]:
    """Raw tokens of the values at ``path``, of a text that ``_scan`` accepts; other than numbers as they begin."""
    out, way, at, keyed = [], [], 0, None
    while True:
        m = TOKEN.match(text, at)
        sign, string, number, word, _ = m.groups()
        if not any(m.groups()):
            return out
        at = m.end()
        if sign in ("}", "]"):
            way.pop()
            keyed = None
        elif sign == ",":
            keyed = None
        elif sign == ":":
            continue
        elif string and way and way[-1][0] == "{" and keyed is None:
            keyed = json.loads(string)
            way[-1] = ("{", keyed)
        else:
            if len(way) == len(path) and tuple(k for _, k in way) == path:
                out.append(number or word or string or sign)
            if sign:
                way.append((sign, None))
                keyed = None


@F.pandas_udf(T.StringType())
def _version_token(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None or refusal(t.encode()) is not None:
            return None
        found = _member_tokens(t, ("header", "version"))
        return found[0] if len(found) == 1 and re.match(r"-?\d", found[0]) else None

    return text.map(one)


def version_token(text: Column) -> Column:
    """The raw number token of ``header.version``, whose form a parsed number has lost; null for a refused text or another value.

    Members called ``version`` elsewhere don't count, nor do texts within strings.
    """
    return _version_token(text)
