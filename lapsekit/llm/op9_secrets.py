"""Secret scan by token efficiency.

Base patterns (assignments, access keys, long hex) stay as they are. The method adds strings that a public
vocabulary spends many tokens on: a run of 20 or more key characters with letters and digits (or lively
case changes) and fewer than ``RATIO`` characters per token. Words, even invented or long ones, compress
better than random strings do. Words in a run would hide a key beside them, so a run that does not look random
is judged in its pieces (between / - _ +) too: each stretch of neighbouring pieces that just reaches 20 characters,
and each piece by windows of 20; flagged ones are joined. Left out: hex of a digest's length (MD5, SHA-1, SHA-2),
UUIDs, plain numbers, and base matches; what a base match leaves of a run is judged as a run.

Spans are code points, end exclusive, ordered by start and then kind. Defined cases: null text = empty;
equal rows are scanned one by one; an empty table gives no rows; extra columns are ignored by ``find_secrets``
and kept by ``redact``.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
RATIO = 1.9
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
PIECE = re.compile(r"[A-Za-z0-9]+")
DIGESTS = {32, 40, 56, 64, 96, 128}
ANY_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
INNER_UUID = re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")
WINDOW_STEP = 4
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
TURN = re.compile(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_LOADED: dict[str, object] = {}


def vocabulary(path: str):
    """The vocabulary's encoder, once per worker process."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def looks_random(s: str, encoding, ratio: float = RATIO) -> bool:
    if not LETTER.search(s) or UUID.match(s) or (ANY_HEX.match(s) and len(s) in DIGESTS):
        return False
    if not DIGIT.search(s) and len(TURN.findall(s)) < len(s) / 4:
        return False
    return len(s) < ratio * len(encoding.encode_ordinary(s))


def dense(s: str, encoding, ratio: float = RATIO) -> bool:
    """Whether the pieces alone take that many tokens: separators would make any path of short names look random."""
    pieces = PIECE.findall(s)
    return sum(map(len, pieces)) < ratio * sum(len(encoding.encode_ordinary(p)) for p in pieces)


def random_parts(s: str, encoding, ratio: float = RATIO) -> list[tuple[int, int]]:
    """The spans of a run that look random: all of it, or what its pieces tell."""
    if looks_random(s, encoding, ratio):
        return [(0, len(s))]
    known = [m.span() for m in INNER_UUID.finditer(s)]
    flagged, group = [], []
    for a, b in [*(m.span() for m in PIECE.finditer(s)), (len(s), len(s))]:
        digest = b - a in DIGESTS and ANY_HEX.match(s[a:b])
        if a < b and not digest and not any(x <= a and b <= y for x, y in known):
            group.append((a, b))
            continue
        tests = set()
        for i, (x, y) in enumerate(group):
            tests.update((x, y, k) for k in {*range(x, y - LEAST, WINDOW_STEP), y - LEAST} if k >= x)
            end = next((v for _, v in group[i:] if v - x >= LEAST), None)
            begin = next((u for u, _ in group[i::-1] if y - u >= LEAST), None)
            tests.update((u, v, -1) for u, v in ((x, end), (begin, y)) if u is not None and v is not None)
        flagged += [(x, y) for x, y, k in tests if looks_random(s[x:y] if k < 0 else s[k:k + LEAST], encoding, ratio)
                    and (k >= 0 or dense(s[x:y], encoding, ratio))]
        group = []
    out: list[tuple[int, int]] = []
    for x, y in sorted(flagged):
        if out and x <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def spans_of(text: str, encoding, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    runs = list(RUN.finditer(text))
    for r in runs:  # a hex run lies inside a run
        out += [("hex", *m.span()) for m in HEX.finditer(text, *r.span())]
    base = out[:]
    for r in runs:
        a, end = r.span()
        for s, e in [*sorted((s, e) for _, s, e in base if s < end and a < e), (end, end)]:
            if s - a >= LEAST:   # what lies before the next base match
                out += [("random", a + x, a + y) for x, y in random_parts(text[a:s], encoding, ratio)]
            a = max(a, e)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, vocabulary_path: str | None = None, ratio: float = RATIO, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, spans: array of (kind, start, end))."""
    path = vocabulary_path or default_vocabulary()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        encoding = vocabulary(path)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t or "", encoding, ratio)]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>"))


def redact(docs: DataFrame, vocabulary_path: str | None = None, ratio: float = RATIO, text: str = "text",
           mask: str = MASK, chars: str | None = None) -> DataFrame:
    """``docs`` with each secret (joined where spans overlap) replaced by ``mask``; other columns as they were.

    ``chars`` names a column with the text's length, brought up to date where the text has changed.
    """
    path = vocabulary_path or default_vocabulary()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        encoding = vocabulary(path)
        return texts.map(lambda t: t if t is None else hide(t, spans_of(t, encoding, ratio), mask))

    name = "_clean"
    while name in docs.columns:
        name = "_" + name
    old, new = F.col(f"`{text}`"), F.col(name)
    out = docs.withColumn(name, clean(old))
    if chars:
        out = out.withColumn(chars, F.when(old != new, F.length(new)).otherwise(F.col(f"`{chars}`")).cast(docs.schema[chars].dataType))
    return out.withColumn(text, new).drop(name)


def hide(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += (text[at:a], mask)
        at = max(at, b)
    return "".join(out) + text[at:]
