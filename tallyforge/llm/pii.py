"""Personal data by candidate gradient boosting (DataFrame functions only).

Generators propose overlapping spans with high recall.  Four of them have exact rules (email, ip, card, phone): what
passes its rule is always redacted.  Every other candidate is scored by boosted trees over format and context features
and redacted if its calibrated probability reaches the threshold.

The trees learn from the text at hand: candidates that coincide with a span that passed a rule are examples, those
that coincide with one that failed its rule (an address part over 255, a wrong check digit, too few or many digits)
are counterexamples; the rules themselves are not features.  A candidate is a pattern of ``len(FEATURES)`` bits, so
all candidates reduce to at most 2 ** 16 counts a class and fold, which is what the driver boosts on.  One fold fits
the trees, the other calibrates (Platt) and sets the threshold: the lowest score from which precision is ``precision``.
Without examples of both classes nothing beyond the exact rules is redacted.

Defined cases: null text is empty and has no spans; repeated rows are scanned one by one; offsets are code points with
exclusive ends; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPAN, cut, match_spans

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?i)[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z]{2,}"
GROUPED = r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "spelled", "grouped", "social", "iban", "number")
CAND = "array<struct<k:int,s:int,e:int,base:boolean,label:int,mask:int>>"


def _digits(m: Column) -> Column:
    return F.char_length(F.regexp_replace(m, "[^0-9]", ""))


def _bits(kind: str, x: Column) -> list[Column]:
    """The features: format of the span, then words before it."""
    m, n, before = x["m"], _digits(x["m"]), F.lower(x["before"])
    return [
        F.lit(kind in ("email", "spelled")),
        F.lit(kind in ("ip",)),
        F.lit(kind in ("card", "number", "grouped", "social", "phone")),
        F.lit(kind == "iban"),
        n >= 9,
        n >= 13,
        n > 16,
        F.contains(m, F.lit("-")),
        F.contains(m, F.lit(" ")),
        F.regexp_like(m, F.lit(r"\.")),
        F.regexp_like(m, F.lit(r"^[+(]")),
        F.regexp_like(before, F.lit(r"mail|contact|write|@")),
        F.regexp_like(before, F.lit(r"phone|tel|call|fax|mobile")),
        F.regexp_like(before, F.lit(r"card|visa|pay|account|iban|bank")),
        F.regexp_like(before, F.lit(r"[:=(]\x20*$")),
        F.regexp_like(before, F.lit(r"[a-z]\x20?$")),
    ]


FEATURES = 16


def _candidates(kind: str, spans: Column, passes, base: bool) -> Column:
    """``passes``: None if the kind has no rule."""

    def one(x: Column) -> Column:
        mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(_bits(kind, x))), F.lit(0))
        label = F.lit(-1) if passes is None else F.when(passes(x["m"]), 1).otherwise(0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"),
            (F.lit(base) & (label == 1)).alias("base"), label.alias("label"), mask.alias("mask"),
        )

    return F.transform(spans, one).cast(CAND)


def propose(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` plus ``cands``: every generator's spans with label (1, 0, -1 unknown) and feature bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    has = lambda needle, spans: F.when(F.contains(text, F.lit(needle)), spans).otherwise(none)
    between = lambda n, lo, hi: (n >= lo) & (n <= hi)
    card = lambda m: between(_digits(m), 13, 19) & F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))
    df = df.withColumns(
        {
            "_email": has("@", match_spans(text, EMAIL)),
            "_ip": has(".", match_spans(text, IP)),
            "_run": match_spans(text, RUN),
            "_phone": has("+", match_spans(text, PHONE)),
            "_spelled": F.when(F.regexp_like(text, F.lit(r"(?i)[(\[\x20]at[)\]\x20]")), match_spans(text, SPELLED)).otherwise(none),
            "_iban": match_spans(text, IBAN),
        }
    )
    digits = F.size("_run") > 0
    df = df.withColumns(
        {
            "_grouped": F.when(digits, match_spans(text, GROUPED)).otherwise(none),
            "_social": F.when(digits, match_spans(text, SOCIAL)).otherwise(none),
        }
    )
    long_run = F.filter("_run", lambda x: between(_digits(x["m"]), 13, 19))
    short_run = F.filter("_run", lambda x: (_digits(x["m"]) >= 8) & ~between(_digits(x["m"]), 13, 19))
    all_of = F.concat(
        _candidates("email", F.col("_email"), lambda m: F.lit(True), True),
        _candidates("ip", F.col("_ip"), lambda m: F.regexp_like(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), True),
        _candidates("card", long_run, card, True),
        _candidates("phone", F.col("_phone"), lambda m: between(_digits(m), 9, 15), True),
        _candidates("spelled", F.col("_spelled"), None, False),
        _candidates("grouped", F.col("_grouped"), None, False),
        _candidates("social", F.col("_social"), None, False),
        _candidates("iban", F.col("_iban"), None, False),
        _candidates("number", short_run, None, False),
    )
    return df.withColumn("cands", F.array_sort(all_of)).drop(
        *[f"_{x}" for x in ("email", "ip", "run", "phone", "spelled", "iban", "grouped", "social")]
    )


def boost(counts: dict[tuple[int, int, int], int], rounds: int = 25, rate: float = 0.4, precision: float = 0.9):
    """Trees of two questions from {(fold, label, mask): rows}; returns (trees, bias, slope, offset, threshold) or None."""
    fit = {}
    for (fold, label, mask), n in counts.items():
        if fold == 0:
            fit.setdefault(mask, [0, 0])[label] += n
    total = [sum(x[c] for x in fit.values()) for c in (0, 1)]
    if not all(total):
        return None
    bias = math.log(total[1] / total[0])
    score = dict.fromkeys(fit, bias)
    trees = []
    for _ in range(rounds):
        grad = {}
        for mask, (neg, pos) in fit.items():
            p = 1 / (1 + math.exp(-score[mask]))
            grad[mask] = (pos - (neg + pos) * p, (neg + pos) * p * (1 - p))
        best = None
        for a in range(FEATURES):
            for b in range(a, FEATURES):
                leaf = [[0.0, 1.0] for _ in range(4)]
                for mask, (g, h) in grad.items():
                    x = leaf[(mask >> a & 1) * 2 + (mask >> b & 1)]
                    x[0] += g
                    x[1] += h
                gain = sum(g * g / h for g, h in leaf)
                if best is None or gain > best[0]:
                    best = (gain, a, b, [rate * g / h for g, h in leaf])
        _, a, b, leaves = best
        trees.append((a, b, leaves))
        for mask in score:
            score[mask] += leaves[(mask >> a & 1) * 2 + (mask >> b & 1)]
    held = [(raw_score(trees, bias, mask), label, n) for (fold, label, mask), n in sorted(counts.items()) if fold == 1]
    slope, offset = _platt(held)
    at_score: dict[float, list[int]] = {}  # all rows of a score stand or fall together
    for s, label, n in held:
        at_score.setdefault(s, [0, 0])[label] += n
    limit, hits, all_rows = None, 0, 0
    for s, (no, yes) in sorted(at_score.items(), reverse=True):
        hits, all_rows = hits + yes, all_rows + no + yes
        if hits >= precision * all_rows:
            limit = s
    return trees, bias, slope, offset, None if limit is None else max(0.5, 1 / (1 + math.exp(-(slope * limit + offset))))


def raw_score(trees, bias: float, mask: int) -> float:
    return bias + sum(leaves[(mask >> a & 1) * 2 + (mask >> b & 1)] for a, b, leaves in trees)


def _platt(rows, steps: int = 200, rate: float = 0.5) -> tuple[float, float]:
    slope, offset, n = 1.0, 0.0, sum(r[2] for r in rows) or 1
    for _ in range(steps):
        ga = gb = 0.0
        for s, label, k in rows:
            d = k * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * s + offset)))))
            ga, gb = ga + d * s, gb + d
        slope, offset = max(0.05, slope + rate * ga / n / 10), offset + rate * gb / n
    return slope, offset


def probability(model, mask: Column) -> Column:
    trees, bias, slope, offset, _ = model
    bit = lambda i: mask.bitwiseAND(F.lit(1 << i)) != 0
    total = F.lit(bias)
    for a, b, (l00, l01, l10, l11) in trees:
        total = total + F.when(bit(a), F.when(bit(b), l11).otherwise(l10)).otherwise(F.when(bit(b), l01).otherwise(l00))
    return 1 / (1 + F.exp(-(total * slope + offset)))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """(id, spans): array of (k, s, e, base, label, mask), the redactions of every row."""
    rows = cut(propose(df.select(id_col, text_col), text_col).select(id_col, "cands"), "pii-candidates")
    seen = rows.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)).alias("fold"), F.explode("cands").alias("c"))
    counts = seen.where("c.label >= 0").groupBy("fold", "c.label", "c.mask").count().collect()  # at most 2 ** 18 rows
    model = boost({(int(f), int(y), int(m)): int(n) for f, y, m, n in counts}, precision=precision)
    keep = lambda c: c["base"]
    if model and model[4] is not None:
        chosen = probability(model, F.col("mask"))
        masks = seen.where("not c.base").select("c.mask").distinct().withColumn("p", chosen)
        good = [r[0] for r in masks.where(F.col("p") >= model[4]).select("mask").collect()]  # at most 2 ** 16
        keep = lambda c: c["base"] | c["mask"].isin(good)
    return rows.select(id_col, F.filter("cands", keep).alias("spans"))


def pii_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find_pii(df, id_col, text_col)
    count = lambda i: F.size(F.filter("spans", lambda x: x["base"] & (x["k"] == i))).cast("long")
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )
    return found.select(
        id_col,
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(text(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
