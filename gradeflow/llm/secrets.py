"""Secret scans with multipart linking.

Three base patterns report on their own.  Weaker parts (a secret-like run of
mixed characters, an endpoint address) are reported only when complementary
parts of a credential meet in one scope: an interval join of access
identifiers, secrets and endpoints inside paragraphs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import steps

# The base patterns of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so a short one can't hide a long one
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "weak_secret", "weak_endpoint")

# The method's own weaker parts.
WEAK = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|wss?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>]+")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match that keeps its conditions."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _mixed(run: str) -> bool:
    """Whether a run looks random: upper case, lower case and digits, in at least 12 different characters."""
    return len(set(run)) >= 12 and any(c.isdigit() for c in run) and run != run.lower() and run != run.upper()


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts with a complementary part in their scope, at any distance.

    Complementary: a secret to an access identifier or endpoint; an endpoint to
    an access identifier or secret (base or weak).  Parts are sorted, so each
    looks up its neighbours by bisection, whatever their number.
    """
    secrets = [(s, e) for s, k, e in base if k in (0, 2)]
    access = [(s, e) for s, k, e in base if k == 1]
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # the furthest end of the base spans so far
    free = lambda s, e: (i := bisect_left(starts, e)) == 0 or reach[i - 1] <= s
    weak = [m.span() for m in WEAK.finditer(text) if _mixed(m.group()) and free(*m.span())]
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not weak and not ends or not (access or ends) or not (secrets or access or weak):
        return []
    breaks = [m.start() for m in SCOPE_END.finditer(text)]

    def meets(at: tuple[int, int], parts: list[tuple[int, int]]) -> bool:
        scope = bisect_right(breaks, at[0])
        low, high = breaks[scope - 1] if scope else 0, breaks[scope] if scope < len(breaks) else len(text)
        k = bisect_left(parts, (low, -1))
        return any(low <= p[0] < high and p != at for p in parts[k : k + 2])

    all_secrets = sorted([*secrets, *weak])
    found = [(s, 3, e) for s, e in weak if meets((s, e), access) or meets((s, e), ends)]
    return found + [(s, 4, e) for s, e in ends if meets((s, e), access) or meets((s, e), all_secrets)]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of secrets per document; one pass over whole texts, no shuffle.

    Returns ``key`` and spans array<struct<kind, start, end>> in code points, by
    start, then kind as listed in ``KINDS``.  A null text is empty and has no
    spans; a document without secrets keeps its row; repeated rows repeat.
    """
    id_type = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                every = sorted(base + linked_spans(t or "", base))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=[key, "spans"])

    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{key}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return spans.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
