"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are long runs of one character class (hexadecimal, base64).  A window slides over each; the
counts of its characters, and the sum of c log2 c over them, change by the character that enters and the one that
leaves.  A window's Shannon entropy is log2(width) less that sum over the width.  A candidate's span reaches from its first
to its last window at or above its class's limit.  An allow-list of harmless forms and the spans that the fixed
patterns found already suppress candidates.  All of it is one projection of SQL functions; nothing is shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, text_of

# The base patterns, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

WINDOW = 20
#: (kind, character class, alphabet, least entropy of a window in bits a character)
CLASSES = (
    ("entropy_hex", "[0-9A-Fa-f]", "0123456789abcdefABCDEF", 3.0),
    ("entropy_base64", "[A-Za-z0-9+/_=-]", string.digits + string.ascii_letters + "+/_=-", 3.7),
)
#: Candidates of these forms are never reported.
ALLOWED = (
    r"^[A-Za-z_/=+-]+$",                                                            # words and paths without digits
    r"^[0-9_/=+-]+$",                                                               # numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",   # UUIDs
    r"^[a-z0-9]+([-_/][a-z0-9]+){3,}$",                                             # slugs and paths in lower case
    r"^(sha1|sha256|sha384|sha512)[-_=]",                                           # checksums that say so
    r"(?i)example|placeholder|xxxxxx|0123456789|abcdefgh|changeme",                 # placeholders
)


def _located(text: Column, found: Column) -> Column:
    """(start, end) of matches given in text order: code points, from 0, end exclusive.

    A match lies where its string first occurs after the match before: at an earlier occurrence the pattern would have matched too.
    """
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, m):
        start = F.call_function("locate", m, text, acc["at"])
        return F.struct((start + F.length(m)).alias("at"),
                        F.array_append(acc["spans"], F.struct((start - 1).alias("start"), (start - 1 + F.length(m)).alias("end"))).alias("spans"))

    return F.aggregate(found, state, step)["spans"]


def _kinds(spans: Column, rank: int, kind: str) -> Column:
    """Spans as (start, rank, end, kind), the order in which they're listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _dense_part(candidate: Column, alphabet: str, least: float, window: int) -> Column:
    """(first, last): starts of the first and the last window with enough entropy, null if there's none."""
    width = len(alphabet)
    weight = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 1)])
    limit = (log2(window) - least) * window
    state = F.struct(F.array_repeat(F.lit(0), width).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    value = lambda c: F.element_at(weight, c + 1)

    def step(acc, i):
        enters = F.call_function("instr", F.lit(alphabet), F.substr(candidate, i, F.lit(1)))
        leaves = F.when(i > window, F.call_function("instr", F.lit(alphabet), F.substr(candidate, F.greatest(i - window, F.lit(1)), F.lit(1)))).otherwise(F.lit(0))
        moved = enters == leaves
        up = F.element_at(acc["counts"], enters)
        down = F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1))))
        # What leaves goes first, so no count exceeds the window.
        change = F.when(moved, F.lit(0.0)).otherwise(value(up + 1) - value(up) + F.when(leaves > 0, value(down - 1) - value(down)).otherwise(F.lit(0.0)))
        total = acc["sum"] + change
        counts = F.when(moved, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda c, k: c + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int")))
        hit = (i >= window) & (total <= limit + 1e-9)
        start = i - window
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit & acc["first"].isNull(), start).otherwise(acc["first"]).alias("first"),
                        F.when(hit, start).otherwise(acc["last"]).alias("last"))

    done = F.aggregate(F.sequence(F.lit(1), F.length(candidate)), state, step)
    return F.struct(done["first"].alias("first"), done["last"].alias("last"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, classes: Sequence[tuple] = CLASSES,
                 allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """One row for each text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists kind:start:end by start, then kind as listed, comma-joined; ``base_sha256`` digests the part of it
    that the fixed patterns give.  Offsets are code points, end exclusive.

    Null text counts as empty: no spans, the digest of the empty string.  Null and repeated ids pass through row by row.
    An empty table gives an empty result; further columns are ignored.
    """
    rows = df.select(col(id_col).alias("doc_id"), text_of(col(text_col)).alias("text"))
    extract = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    rows = rows.withColumns({"assigned": extract(ASSIGN), "values": extract(ASSIGN, 2), "keys": extract(f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"),
                             "hexes": extract(f"[0-9a-f]{{{MIN_HEX},}}"), **{name: extract(f"{cls}{{{window},}}") for name, cls, _, _ in classes}})
    text = F.col("text")
    # Short assigned values still use up their text, so they're located before they are dropped.
    located = F.zip_with(_located(text, F.col("assigned")), "values", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")))
    assign = F.filter(located, lambda s: s["n"] >= MIN_ASSIGN)
    rows = rows.withColumn("assign", _kinds(assign, 0, "assign"))
    rows = rows.withColumns({"access": _kinds(_located(text, F.col("keys")), 1, "access"), "hex": _kinds(_located(text, F.col("hexes")), 2, "hex")})
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    found = [F.col("base")]
    for k, (name, _, alphabet, least) in enumerate(classes):
        # A candidate is what the class matches; where, before whether: each needs the matches in order.
        spans = F.zip_with(_located(text, F.col(name)), F.col(name), lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), c.alias("text")))
        free = F.filter(spans, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
        harmless = "|".join(f"(?:{pattern})" for pattern in allowed) or "(?!)"
        free = F.filter(free, lambda s: ~s["text"].rlike(harmless))
        if name != "entropy_hex":
            free = F.filter(free, lambda s: ~s["text"].rlike("^[0-9A-Fa-f]+$") & s["text"].rlike("[0-9]") & s["text"].rlike("[a-zA-Z]"))
        parts = F.transform(free, lambda s: F.struct(s["start"].alias("start"), _dense_part(s["text"], alphabet, least, window).alias("part")))
        parts = F.filter(parts, lambda s: s["part"]["first"].isNotNull())
        dense = F.transform(parts, lambda s: F.struct((s["start"] + s["part"]["first"]).alias("start"), (s["start"] + s["part"]["last"] + window).alias("end")))
        found.append(_kinds(dense, 3 + k, name))
    count = lambda name: F.size(name).cast("bigint").alias(f"n_{name}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.concat(*found)).alias("spans"))
