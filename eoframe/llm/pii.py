"""Personal data by candidate gradient boosting, in DataFrame functions only.

* High-recall generators propose spans of eight kinds. Four have a fixed rule and are
  always found (email, ip, card, phone); the others (secret, number, contact, address)
  are loose patterns that overlap them and each other.
* Every proposed span gets format features (digits, letters, separators, length,
  different characters, checksum, leading plus) and a context feature (a cue word or an
  assignment before it).
* Boosted trees score the spans. They are fitted to the counts of distinct feature
  tuples over all proposed spans, a table bounded by the features' ranges, and compiled
  to one SQL expression. Spans that pass a fixed rule are positive examples; spans that
  fail one, and words without digits or cues, are negative; the rest is unlabelled.
* A threshold per kind is calibrated on the scores, and spans above it that don't touch
  a fixed-rule span are added to them.

Positions come from the text cut at its matches: a match is wrapped in a control
character (which the text itself has replaced by another one), the pieces' lengths are
summed per document. All steps after the scan move pieces, never texts, and nothing is
gathered but one document's spans.

Patterns are possessive where that leaves their matches as they are, so that long runs
of digits or letters cost no recursion and no rescans.

Null and empty texts have no spans and get the hash of the empty string. Repeated rows
and null ids are reported each; an empty table gives an empty result; other columns of
the input are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, packed_rows, table, two_columns
from .registry import register

BASE = ("email", "ip", "card", "phone")
#: Kind and pattern, in the order of the output. \G lets a match start where the one
#: before ended, inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # "=" is a separator, but for one or two at the end of a run.
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+(?:={1,2}+(?![A-Za-z0-9_+/=-]))?+",
    "number": r"(?<![0-9.+-])\(?[0-9]{2,19}+(?:[\x20.()-]{1,2}[0-9]{2,19}+){0,5}+(?![0-9])",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}+"
               r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}+)++",
    "address": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){5,7}+(?![0-9A-Fa-f:])",
}
KINDS = tuple(PATTERNS)
CUES = (r"(?i)(?:token|secret|passw(?:or)?d|api.?key|auth|bearer|phone|tel|mobile|call|fax|card|visa|account|iban|ssn|"
        r"passport|mail|contact|address|host|server)\b")
FEATURES = {"kind": len(KINDS), "digits": 24, "letters": 8, "separators": 8, "size": 10, "different": 8, "checksum": 2,
            "plus": 2, "cue": 2, "assigned": 2}
TREES, DEPTH, RATE = 40, 3, 0.3
CONTEXT = 24

_MARK, _OTHER = "\x01", "\x02"


@dataclass(frozen=True)
class Redactor:
    """Boosted trees as a SQL expression of the features, and a threshold per kind."""

    score_sql: str
    thresholds: dict


def proposed(docs: DataFrame, keep=()) -> DataFrame:
    """(row_id, doc_id, *keep, kind, start, end, match, before): all generators' spans of
    (row_id, doc_id, text, *keep); a document without any has one row of null kind."""
    text = F.translate(F.coalesce("text", F.lit("")), _MARK, _OTHER)
    marked = docs.select("row_id", "doc_id", *keep, *[
        F.split(F.regexp_replace(text, F.lit(p), F.lit(f"{_MARK}$0{_MARK}")), _MARK).alias(k) for k, p in PATTERNS.items()])
    # Pieces at odd places are matches; of the others the length and the end are enough.
    piece = "transform({k}, (p, i) -> struct({n} AS k, i AS i, char_length(p) AS n, " \
            f"if(i % 2 = 1, p, right(p, {CONTEXT})) AS s))"
    none = "array_remove(array(struct(0 AS k, 0 AS i, 0 AS n, '' AS s)), struct(0 AS k, 0 AS i, 0 AS n, '' AS s))"
    parts = [f"if(size({k}) > 1, {piece.format(k=k, n=n)}, {none})" for n, k in enumerate(KINDS)]
    rows = marked.select("row_id", "doc_id", *keep, F.explode_outer(F.expr(f"concat({', '.join(parts)})")).alias("p"))
    rows = rows.select("row_id", "doc_id", *keep, F.col("p.k").alias("kind"), "p.i", "p.n", "p.s")
    w = Window.partitionBy("row_id", "kind").orderBy("i")
    rows = (rows.withColumn("end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("before", F.lag("s").over(w)))
    return (rows.where("kind is null or i % 2 = 1")
            .select("row_id", "doc_id", *keep, "kind", (F.col("end") - F.col("n")).alias("start"), "end",
                    F.col("s").alias("match"), "before"))


def _luhn(digits: str) -> str:
    """SQL: does the string of digits pass Luhn's checksum."""
    double = "d * 2 - if(d > 4, 9, 0)"
    return (f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> transform(array(try_cast(c AS int)), "
            f"d -> if(i % 2 = 1, {double}, d))[0]), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0")


def described(spans: DataFrame) -> DataFrame:
    """Adds the features and `base`: the span passes its kind's fixed rule (null: the kind
    has none)."""
    d = spans.withColumn("d", F.regexp_replace("match", "[^0-9]", ""))
    d = d.withColumn("checksum", F.expr(f"if(length(d) BETWEEN 13 AND 19, {_luhn('d')}, false)"))
    kind = dict(zip(KINDS, range(len(KINDS)), strict=True))
    parts_fit = F.expr("forall(transform(split(match, '[.]'), x -> regexp_replace(x, '^0+', '')), "
                       "x -> length(x) <= 3 AND coalesce(try_cast(x AS int), 0) <= 255)")
    base = (F.when(F.col("kind") == kind["email"], F.lit(True))
            .when(F.col("kind") == kind["ip"], parts_fit)
            .when(F.col("kind") == kind["card"], F.col("checksum"))
            .when(F.col("kind") == kind["phone"], F.length("d").between(9, 15)))

    def log2(c):
        return F.ceil(F.log2(c + 1)).cast("int")

    letters = F.length(F.regexp_replace("match", "[^A-Za-z]", ""))
    rest = F.length(F.regexp_replace("match", "[A-Za-z0-9]", ""))
    features = {
        "digits": F.least(F.length("d"), F.lit(23)),
        "letters": F.least(log2(letters), F.lit(7)),
        "separators": F.least(rest, F.lit(7)),
        "size": F.least(log2(F.length("match")), F.lit(9)),
        "different": F.least(F.expr("size(array_distinct(split(left(match, 64), '')))"), F.lit(28)) / F.lit(4),
        "checksum": F.col("checksum"),
        "plus": F.col("match").startswith("+"),
        "cue": F.coalesce(F.col("before").rlike(CUES), F.lit(False)),
        "assigned": F.coalesce(F.col("before").rlike("[=:]\\s*[\"']?$"), F.lit(False)),
    }
    return (d.withColumn("base", base).withColumns({k: v.cast("int") for k, v in features.items()})
            .drop("d", "match", "before"))


def _label():
    """1, 0 or null: what is known of a span without the trees."""
    cued = (F.col("cue") + F.col("assigned")) > 0
    loose = F.col("kind") >= len(BASE)
    return (F.when(F.col("base"), 1)
            .when(loose & cued & (F.col("digits") >= 6), 1)
            # The checksum fails for nine in ten numbers of a card's form: not a negative.
            .when((F.col("kind") == BASE.index("card")) & F.col("digits").between(13, 19), None)
            .when(F.col("base") == F.lit(False), 0)
            .when(loose & ~cued & (F.col("digits") <= 5), 0))


def _grow(x, g, h, rows, depth, names):
    """A regression tree on gradients: (sql, values of all rows)."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    value = float(RATE * total_g / (total_h + 1.0))
    if depth == 0 or not rows.any():
        return f"{value!r}D", np.where(rows, value, 0.0)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1]:
            left = rows & (x[:, f] <= cut)
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl ** 2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g ** 2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is None:
        return f"{value!r}D", np.where(rows, value, 0.0)
    left = rows & (x[:, best[1]] <= best[2])
    a, va = _grow(x, g, h, left, depth - 1, names)
    b, vb = _grow(x, g, h, rows & ~left, depth - 1, names)
    return f"if({names[best[1]]} <= {int(best[2])}, {a}, {b})", va + vb


def fit(spans: DataFrame, precision: float = 0.9) -> Redactor:
    """Boosted trees on the counts of distinct (features, label) of all spans."""
    names = list(FEATURES)
    got = (spans.where("kind is not null").withColumn("y", _label()).groupBy(*names, "y")
           .agg(F.count("*").alias("n")).where("y is not null").collect())
    n1 = sum(r["n"] for r in got if r["y"] == 1)
    n0 = sum(r["n"] for r in got if r["y"] == 0)
    if not n1 or not n0:
        return Redactor("-10.0D", dict.fromkeys(KINDS, 0.5))
    x = np.array([[r[f] for f in names] for r in got], np.int64)
    y, n = np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float)
    # Half of the weight on each side, and less than proportional to repetition.
    n = np.sqrt(n)
    n *= np.where(y == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum()) * len(n)
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        sql, value = _grow(x, n * (y - p), n * p * (1 - p), np.ones(len(y), bool), DEPTH, names)
        trees.append(sql)
        score += value
    p = 1 / (1 + np.exp(-score))
    thresholds = {}
    for k, name in enumerate(KINDS):
        own = x[:, 0] == k
        fits = [t for t in np.linspace(0.5, 0.95, 10)
                if (w := n[own & (p >= t)].sum()) and (n * y)[own & (p >= t)].sum() >= precision * w]
        thresholds[name] = float(min(fits, default=0.5 if not own.any() else 0.95))
    return Redactor(" + ".join(trees), thresholds)


def _selected(spans: DataFrame, model: Redactor) -> DataFrame:
    """Fixed-rule spans and, of the others, those above their threshold that touch none of
    them and no added span before them."""
    cut = F.element_at(F.create_map(*[F.lit(v) for kv in
                                      ((i, math.log(t / (1 - t))) for i, t in enumerate(model.thresholds[k] for k in KINDS))
                                      for v in kv]), F.col("kind"))
    s = spans.withColumn("fixed", F.coalesce("base", F.lit(False)))
    s = s.withColumn("score", F.expr(model.score_sql)).withColumn("added", ~F.col("fixed") & (F.col("score") >= cut))
    # Rows that fall out stay as rows without a kind: a document keeps one at least.
    s = s.withColumn("kind", F.when(F.col("fixed") | F.col("added"), F.col("kind")))
    order = Window.partitionBy("row_id").orderBy("start", "kind")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # What follows, read backwards: a frame that only grows costs a step a row.
    ahead = Window.partitionBy("row_id").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    fixed_end, fixed_start = F.when(F.col("fixed"), F.col("end")), F.when(F.col("fixed"), F.col("start"))
    added_end = F.when(F.col("added"), F.col("end"))
    s = s.withColumns({"fixed_before": F.max(fixed_end).over(past), "fixed_after": F.min(fixed_start).over(ahead),
                       "added_before": F.max(added_end).over(past)})
    free = ((F.coalesce("fixed_before", F.lit(-1)) <= F.col("start"))
            & (F.coalesce(F.col("fixed_after"), F.col("end")) >= F.col("end"))
            & (F.coalesce("added_before", F.lit(-1)) <= F.col("start")))
    return s.withColumn("kind", F.when(F.col("fixed") | (F.col("added") & free), F.col("kind")))


def _joined(cond):
    """kind:start:end of the spans that meet cond, by kind as listed, then start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.sort_array(F.collect_list(F.when(cond & F.col("kind").isNotNull(), F.struct("kind", "start", "end"))))
    return F.concat_ws(",", F.transform(each, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, n_email, n_ip, n_card, n_phone, base, spans): a row per row of docs.

    `base` and `spans` list kind:start:end, comma-joined: the fixed-rule spans, and these
    with the added ones. Positions are code points, end exclusive.
    """
    docs = two_columns(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())
    spans = materialise(described(proposed(docs)))
    chosen = _selected(spans, fit(spans))
    counts = [F.count(F.when(F.col("fixed") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return (chosen.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), *counts, _joined(F.col("fixed")).alias("base"),
        _joined(F.col("kind").isNotNull()).alias("spans")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all columns, with each found span (overlapping ones as one) replaced by its
    kind in angle brackets. ``length_col``, if given, gets the length of changed texts.

    A row is known by its id and a hash of its text, so rows with equal ids keep their own
    spans. Only documents with spans have rows in the joined side.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ids = rows.withColumn("row_id", F.monotonically_increasing_id()).withColumn("key", key_of_text("text"))
    spans = materialise(described(proposed(ids, keep=("key",))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    chosen = (_selected(spans, fit(spans)).where("kind is not null")
              .select("doc_id", "key", "start", "end", names[F.col("kind")].alias("tag")).distinct())
    # Spans that overlap one before them belong to its group; a group becomes one tag.
    order = Window.partitionBy("doc_id", "key").orderBy("start", "end", "tag")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = chosen.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    grouped = grouped.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("doc_id", "key", "part").agg(
        F.min(F.struct("start", "end", "tag"))["tag"].alias("tag"), F.min("start").alias("start"), F.max("end").alias("end"))
    per_doc = (merged.groupBy(F.col("doc_id").alias("id_"), F.col("key").alias("key_"))
               .agg(F.sort_array(F.collect_list(F.struct("start", "end", "tag"))).alias("spans_")))
    held = packed_rows(docs).withColumn("text_", F.col(f"row_.`{text_col}`"))
    both = held.join(per_doc, F.col(f"row_.`{id_col}`").eqNullSafe(F.col("id_")) & (key_of_text("text_") == F.col("key_")), "left")
    # Four bytes a character, so that a stretch is found without walking the text. Behind
    # a Generate, or it would be encoded again for every span.
    wide = F.when(F.col("spans_").isNotNull(), F.encode("text_", "UTF-32"))
    both = both.select("*", F.inline(F.array(F.struct(wide.alias("wide_")))))
    pieces = ("concat(concat_ws('', transform(spans_, (s, i) -> concat(decode(substring(wide_, "
              "cast(4 * if(i = 0, 0, spans_[i - 1].end) AS int) + 1, cast(4 * (s.start - if(i = 0, 0, spans_[i - 1].end)) AS int)), "
              "'UTF-32'), s.tag))), decode(substring(wide_, cast(4 * spans_[size(spans_) - 1].end AS int) + 1), 'UTF-32'))")
    changed = F.col("spans_").isNotNull()
    out = both.withColumn("clean_", F.when(changed, F.expr(pieces)).otherwise(F.col("text_")))
    cols = []
    for c in docs.columns:
        own = F.col(f"row_.`{c}`")
        if c == text_col:
            own = F.col("clean_")
        elif c == length_col:
            own = F.when(changed, F.length("clean_")).otherwise(own).cast(docs.schema[c].dataType)
        cols.append(own.alias(c))
    return out.select(*cols)


def key_of_text(text_col: str):
    return F.xxhash64(F.col(f"`{text_col}`"))


@register("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
