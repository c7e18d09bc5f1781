"""Decoding: percent, hexadecimal, base64 and Unicode escapes in a text, again and again, and scans of the results.

One Arrow function decodes a fragment to all depths; the scan of decoded text is the same as that of plain text. Each
decoded range knows the range of the original that it came from, so findings are located there.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhound.functions import text as T
from keyhound.plans.rules import Config

from .scan import finish, prefiltered, raw_matches, trimmed

MIN_HEX, MIN_BASE64 = 32, 16
_H = rb"[0-9A-Fa-f]"
_FIND = re.compile(
    rb"(?P<percent>%" + _H + _H + rb"(?:[^\n]*%" + _H + _H + rb")?)"
    rb"|(?P<points>U\+" + _H + rb"{4}(?=\s|\Z)(?:\s+U\+" + _H + rb"{4}(?=\s|\Z))*)"
    rb"|(?P<escapes>(?:\\\\[uU]" + _H + rb"{4}(?=[\s\S])|\\[uU]" + _H + rb"{4})(?:\\\\?[uU]" + _H + rb"{4})*)"
    rb"|(?P<run>[0-9A-Za-z_/+-]+)(?P<pad>={0,2})"
)
_SEGMENTS = "array<struct<ds:int,de:int,os:int,oe:int,kind:string>>"


def _printable(b: bytes) -> bool:
    return all(8 < c < 127 for c in b)


def _percent(b: bytes) -> bytes | None:
    found = re.findall(rb"%(" + _H + _H + rb")", b)
    if not _printable(bytes(int(x, 16) for x in found)):
        return None
    return re.sub(rb"%(" + _H + _H + rb")", lambda m: bytes([int(m[1], 16)]), b)


def _hex(b: bytes) -> bytes | None:
    if len(b) % 2 or not re.search(rb"[0-9]", b):
        return None
    out = binascii.unhexlify(b)
    return out if _printable(out) else None


def _base64(b: bytes) -> bytes | None:
    if not re.search(rb"[0-9+/_-]", b):
        return None
    bare = b.rstrip(b"=")
    for text, alphabet in ((b, None), (bare + b"=" * (-len(bare) % 4) if len(bare) == len(b) else b, b"-_")):
        if len(text) % 4 or (alphabet and re.search(rb"[+/]", text)) or (not alphabet and re.search(rb"[-_]", text)):
            continue
        try:
            out = base64.b64decode(text, altchars=alphabet, validate=True)
        except (binascii.Error, ValueError):
            continue
        if out and _printable(out):
            return out
    return None


def _points(b: bytes) -> bytes | None:
    codes = [int(x, 16) for x in re.findall(rb"[uU]\+?(" + _H + rb"{4})", b)]
    return "".join(map(chr, codes)).encode("utf-8", "replace")


def decode_once(b: bytes) -> tuple[bytes, list[tuple[int, int, int, int, str]]]:
    """The text with what can be decoded put in place, and (encoded from, to, decoded from, to, kind) of each place."""
    out, places, at = [], [], 0
    size = 0
    for m in _FIND.finditer(b):
        kind, begin, end, made = m.lastgroup, m.start(), m.end(), None
        if m["percent"]:
            kind, made = "percent", _percent(m[0])
        elif m["points"] or m["escapes"]:
            kind, made = "unicode", _points(m[0])
        elif len(m["run"]) >= MIN_HEX and re.fullmatch(_H + rb"+", m["run"]):
            kind, end, made = "hex", m.end("run"), _hex(m["run"])
        elif len(m["run"]) >= MIN_BASE64:
            kind, made = "base64", _base64(m[0])
        if made is None:
            continue
        out.append(b[at:begin])
        size += begin - at
        places.append((begin, end, size, size + len(made), kind))
        out.append(made)
        size += len(made)
        at = end
    return b"".join([*out, b[at:]]), places


def to_original(segments: list[tuple[int, int, int, int]], begin: int, end: int) -> tuple[int, int]:
    """A range of a decoded text as a range of the original; segments: decoded from, to, original from, to, in order."""
    shift = 0
    a = z = None
    for ds, de, os_, oe in segments:
        if a is None and begin < de:
            a = os_ if begin >= ds else begin + shift
        if z is None and end <= de:
            z = oe if end > ds else end + shift
        shift = oe - de
    return begin + shift if a is None else a, end + shift if z is None else z


def decode_all(raw: str, depth: int) -> list[tuple[int, str, list[dict]]]:
    """pass, text, segments for each depth at which something was decoded."""
    found, text, known = [], raw.encode("utf-8", "surrogatepass"), []
    for n in range(1, depth + 1):
        text_, places = decode_once(text)
        if not places:
            break
        rows = []
        for eb, ee, db, de, kind in places:
            inner = [s for s in known if s["ds"] < ee and eb < s["de"]]
            a, z = to_original([(s["ds"], s["de"], s["os"], s["oe"]) for s in known], eb, ee)
            kinds = sorted({kind, *(k for s in inner for k in s["kind"].split("+"))})
            rows.append({"ds": db, "de": de, "os": a, "oe": z, "kind": "+".join(kinds)})
        # What was decoded before and is still there moves along.
        for s in known:
            if not any(eb < s["de"] and s["ds"] < ee for eb, ee, *_ in places):
                move = sum((de - db) - (ee - eb) for eb, ee, db, de, _ in places if ee <= s["ds"])
                rows.append(s | {"ds": s["ds"] + move, "de": s["de"] + move, "kind": s["kind"] + "!"})
        known = sorted(({**r, "kind": r["kind"].rstrip("!")} for r in rows), key=lambda r: r["ds"])
        fresh = {r["ds"] for r in rows if not r["kind"].endswith("!")}
        text = text_
        found.append((n, text.decode("utf-8", "replace"), [{**s, "kind": s["kind"] if s["ds"] in fresh else ""} for s in known]))
    return found


def decoded(df: DataFrame, depth: int) -> DataFrame:
    """Fragments by depth of decoding: raw is the decoded text, original the fragment's own, with segments."""
    names = ("fragment_id", "raw", "start_line", "attributes", "original", "pass", "segments")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {n: [] for n in names}
            take = []
            for i, raw in enumerate(b.column("raw").to_pylist()):
                for n, text, segments in decode_all(raw or "", depth):
                    take.append(i)
                    rows["raw"].append(text)
                    rows["pass"].append(n)
                    rows["segments"].append(segments)
            at = pa.array(take, pa.int64())
            seg = pa.list_(pa.struct([("ds", pa.int32()), ("de", pa.int32()), ("os", pa.int32()), ("oe", pa.int32()), ("kind", pa.string())]))
            kept = {"fragment_id": b.column("fragment_id").take(at), "start_line": b.column("start_line").take(at), "attributes": b.column("attributes").take(at), "original": b.column("raw").take(at)}
            cols = kept | {"raw": pa.array(rows["raw"], pa.string()), "pass": pa.array(rows["pass"], pa.int32()), "segments": pa.array(rows["segments"], seg)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=list(names))

    kind = df.schema["fragment_id"].dataType.simpleString()
    schema = f"fragment_id {kind}, raw string, start_line int, attributes map<string,string>, original string, pass int, segments {_SEGMENTS}"
    return df.select("fragment_id", "raw", "start_line", "attributes").mapInArrow(go, schema)


def decoded_findings(df: DataFrame, config: Config, depth: int, **options) -> DataFrame:
    """Findings in decoded text that overlap what was decoded last, at their places in the original."""
    m = trimmed(raw_matches(decoded(prefiltered(df, config), depth), list(config.rules.values())).where(F.col("match").isNotNull()))
    m = m.withColumn("own", F.filter("segments", lambda s: (s["kind"] != "") & (s["ds"] <= F.col("bend")) & (s["de"] >= F.col("bstart")))).where(F.size("own") > 0)
    before = lambda at: F.filter("segments", lambda s: s["ds"] < at)
    last_a, last_z = F.try_element_at(F.filter("segments", lambda s: s["ds"] <= F.col("bstart")), F.lit(-1)), F.try_element_at(before(F.col("bend")), F.lit(-1))
    start = F.when(last_a.isNull(), F.col("bstart")).when(F.col("bstart") < last_a["de"], last_a["os"]).otherwise(F.col("bstart") + last_a["oe"] - last_a["de"])
    end = F.when(last_z.isNull(), F.col("bend")).when(F.col("bend") <= last_z["de"], last_z["oe"]).otherwise(F.col("bend") + last_z["oe"] - last_z["de"])
    kinds = F.array_sort(F.array_distinct(F.flatten(F.transform("own", lambda s: F.split(s["kind"], r"\+")))))
    tags = F.concat(F.transform(kinds, lambda k: F.concat(F.lit("decoded:"), k)), F.array(F.concat(F.lit("decode-depth:"), F.col("pass").cast("string"))))
    head = F.substring_index(F.substring(F.col("raw"), F.lit(1), F.col("cstart")), "\n", -1)
    tail = F.substring_index(F.substring(F.col("raw"), F.col("cstart") + 1, F.char_length("raw")), "\n", 1)
    m = m.withColumns({"at": F.col("bstart"), "new_a": start, "new_z": end, "more_tags": tags, "decoded_line": F.concat(head, tail), "scanned": F.col("raw")})
    m = m.withColumns({"raw": F.col("original"), "bstart": F.col("new_a"), "bend": F.col("new_z")})
    m = m.withColumn("span", T.bytes_between(F.col("raw"), F.col("bstart"), F.col("bend"))).withColumn("cstart", F.char_length(T.bytes_between(F.col("raw"), F.lit(0), F.col("bstart"))))
    return finish(m.drop("own", "new_a", "new_z", "segments", "original"), config, **options)
