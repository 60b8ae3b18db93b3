"""Secret scans: fixed patterns, and random strings that a token vocabulary compresses badly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .bpe import load_ranks

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Lengths of hexadecimal digests in common use: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile("|".join(f"[0-9A-Fa-f]{{{n}}}" for n in DIGESTS))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Names as code and prose have them: words and numbers joined by marks, in lower case, capitals or camel case.
#: Parts are taken whole, so that a long run is read once: capitals leave their last one to a word that it begins.
_PART = r"(?>[A-Z]{2,}(?=[A-Z][a-z]{2})|[A-Z]{2,}(?![A-Za-z])|[A-Z]?[a-z]{2,}|[0-9]{1,4}(?![0-9]))"
_NAME = re.compile(rf"[+/_-]*+(?:{_PART}(?:[+/_-]++|(?=[A-Z])|$))++|[a-z]++|[A-Z][a-z]*+|[A-Z]++|[0-9+/_-]++")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost matches of each kind that do not overlap, failing ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def random_spans(text: str, encoder: tiktoken.Encoding, ratio: float) -> list[tuple[int, int, str]]:
    """Runs of 20 characters or more that take a token for every ``ratio`` characters or fewer.

    Known digests, UUIDs, numbers and names are left out: their form says what they are.
    """
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _NAME.fullmatch(run):
            continue
        if len(run) < ratio * len(encoder.encode_ordinary(run)):
            found.append((m.start(), m.end(), "random"))
    return found


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def scan(docs: DataFrame, path: str, pattern: str, ratio: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<start, end, kind>>, one row for each row of ``docs``.

    Offsets are code points, the end exclusive; spans are in order of start, then of kind as in ``KINDS``. Random
    runs are spans of their own where no span of a fixed pattern covers them. Null and empty texts have no spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path, pattern)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = [s for s in random_spans(text or "", vocabulary, ratio) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text").mapInArrow(
        run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>"
    )
