"""Secret scans with multipart credential linking.

Three base patterns (keyword assignments, access identifiers, long hex runs)
are reported wherever they occur. Weak candidates - values and endpoints that
are too common to report alone - are reported only when complementary parts
meet: inside a scope (a run of lines without a blank line) every anchor, an
access identifier or a keyword assignment, is linked with all opaque values and
endpoints of the scope. A value and an endpoint without an anchor are not.

Map-only: one pass over the texts, no shuffle. A lost executor re-runs its
input split. Null and empty texts have no spans; repeated rows are scanned
alike; extra columns of the input are ignored or (``redact``) kept."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns, in report order
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "paired_secret", "paired_endpoint")
KEYWORDS = ("passw", "secret", "token", "api")

# weak parts: an opaque value of 32 or more characters, a URL or host:port
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{32,}(?![A-Za-z0-9+/=_-])", re.A)
# (a host name is tried from its first character only and never given back, so a long run costs one scan)
ENDPOINT = re.compile(r"(?:https?|s3|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[^\s\"'<>]+"
                      r"|(?<![\w-])(?<![a-z0-9-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++:\d{2,5}\b", re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of one text, in report order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that share a scope with an anchor, however far apart they lie:
    one sweep over the parts in order with the kinds each scope holds. A value
    must be mixed (a digit and both letter cases) to count; an endpoint counts
    only where its scope holds an assignment, or an identifier and a secret
    (a value or a hex run)."""
    if not any(k < 2 for _, k, _ in base):
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]
    scope = lambda p: bisect.bisect_right(cuts, p)
    kinds: dict[int, set] = {}
    for a, k, _ in base:
        kinds.setdefault(scope(a), set()).add(k)
    anchored = {s for s, has in kinds.items() if has & {0, 1}}
    ends = list(itertools.accumulate((b for _, _, b in base), max))  # base is sorted by start
    starts = [a for a, _, _ in base]

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    found = []
    for m in OPAQUE.finditer(text):
        v, s = m[0], scope(m.start())
        if s in anchored and free(*m.span()) and re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v):
            found.append((m.start(), 3, m.end()))
            kinds[s].add(3)
    complete = {s for s in anchored if 0 in kinds[s] or kinds[s] & {2, 3}}
    for m in ENDPOINT.finditer(text):
        if scope(m.start()) in complete and free(*m.span()):
            found.append((m.start(), 4, m.end()))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans) of one text; null is empty."""
    base = base_spans(text or "")
    return base, sorted(base + linked_spans(text or "", base))


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, the sha256 of the base
    spans, and all spans as ``kind:start:end`` (code points, end exclusive)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for rb in batches:
            n, sha, txt = [[], [], []], [], []
            for text in rb.column(1).to_pylist():
                base, every = scan(text)
                for k in range(3):
                    n[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                txt.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array(txt, pa.string())], names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Every found span (base and linked; overlapping spans as one) replaced by
    ``mark``; ``n_chars``, if there, is set anew for changed texts. Same rows
    and columns as the input; null texts stay null."""
    names = df.columns
    at = names.index(text_col)
    count_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(at).to_pylist()
            counts = rb.column(count_at).to_pylist() if count_at is not None else []
            for i, t in enumerate(texts):
                every = scan(t)[1] if t else []
                if not every:
                    continue
                parts, pos = [], 0
                for a, _, b in every:
                    if a >= pos:
                        parts += [t[pos:a], mark]
                    pos = max(pos, b)
                texts[i] = "".join(parts) + t[pos:]
                if count_at is not None:
                    counts[i] = len(texts[i])
            cols = list(rb.columns)
            cols[at] = pa.array(texts, cols[at].type)
            if count_at is not None:
                cols[count_at] = pa.array(counts, cols[count_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=rb.schema)

    return df.mapInArrow(run, df.schema)
