"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of one character class (base64-like, or hexadecimal).  A
window moves along it while its character counts, and with them its entropy, are updated
by one character in and one out.  Windows over the class's threshold merge into spans.
An allow list suppresses candidates that are harmless as a whole: runs without letters,
repeated pieces, counting sequences, identifiers in UUID form, words and numbers joined by
signs, and runs without digits that are cased like words or in capitals.

Nulls: a null text is empty.  Rows with null or repeated ids are scanned like any other;
an empty table gives no rows.  Texts are scanned whole.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .core import keyed_docs

#: Fixed patterns (values given by the data contract), in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Without one of these there is no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Window, and by class its characters and the entropy (bits a character) that a window must reach.
WINDOW = 20
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{%d,}" % WINDOW), 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), 3.7),
)
#: Share of neighbouring characters that count up, from which a candidate is a sequence; share of capitals among the letters of keys.
COUNTING, MIXED = 0.8, (0.35, 0.9)
#: Candidates that match one of these as a whole are harmless: no letter; a UUID; a short piece over and over; words and a number.
ALLOW = (
    re.compile(r"[^A-Za-z]*"),
    re.compile(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"(.{1,4})\1+"),
    re.compile(r"[A-Za-z]+([-_/=][A-Za-z]+)*[-_/=][0-9]{1,4}"),
)


def harmless(run: str) -> bool:
    """The allow list, over a whole candidate: a part of it that looks harmless excuses nothing.

    Besides the patterns: sequences that count up (digits, alphabets, character tables), and
    runs without a digit that have as few capitals as words in camel case, or hardly others.
    """
    if any(a.fullmatch(run) for a in ALLOW):
        return True
    pairs = list(zip(run, run[1:]))
    if sum(ord(b) - ord(a) == 1 or a + b == "90" for a, b in pairs) >= COUNTING * len(pairs):
        return True
    letters = [c for c in run if c.isalpha()]
    return not any(c.isdigit() for c in run) and not MIXED[0] <= sum(c.isupper() for c in letters) / len(letters) <= MIXED[1]


_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(s: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``s`` whose entropy is ``least`` bits or more, by incremental counts."""
    counts: Counter = Counter(s[:window])
    total = sum(_PLOGP[c] for c in counts.values())
    bound, out = window * (math.log2(window) - least), []
    for i in range(len(s) - window + 1):
        if i:
            gone, come = s[i - 1], s[i + window - 1]
            if gone != come:
                c = counts[gone]
                total += _PLOGP[c - 1] - _PLOGP[c]
                counts[gone] = c - 1
                c = counts[come]
                total += _PLOGP[c + 1] - _PLOGP[c]
                counts[come] = c + 1
        # entropy = log2(window) - sum(c log2 c) / window
        if total <= bound + 1e-9:
            if out and out[-1][1] >= i:
                out[-1] = (out[-1][0], i + window)
            else:
                out.append((i, i + window))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of high entropy that no fixed pattern covers yet."""
    found: list[tuple[int, int]] = []
    for _, pattern, least in CLASSES:
        for m in pattern.finditer(text):
            run = m[0]
            if not harmless(run):
                found += [(m.start() + a, m.start() + b) for a, b in hot_windows(run, least)]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, reach, k = [], 0, 0
    for a, b in merged:
        # the farthest end of the fixed spans that start no later
        while k < len(taken) and taken[k][0] <= a:
            reach = max(reach, taken[k][2])
            k += 1
        if b > reach:
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points), and clean_text if asked for."""

    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols: list[list] = [[] for _ in range(6)]
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans = sorted(base + entropy_spans(text, base))
                    kinds = Counter(k for _, k, _ in base)
                    values = (kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(text, spans) if keep_text else None)
                    for c, v in zip(cols, values):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"],
                )

    out = keyed_docs(df, id_col, text_col).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string")
    return out if keep_text else out.drop("clean_text")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets in its text column replaced by a mark; all rows and columns stay, null stays null."""
    schema, at = df.schema, df.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = []
                for text in part.column(at).to_pylist():
                    if text:
                        base = base_spans(text)
                        text = redacted(text, sorted(base + entropy_spans(text, base)))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(at).type) if i == at else part.column(i) for i in range(part.num_columns)], schema=part.schema)

    return df.mapInArrow(clean, schema)
