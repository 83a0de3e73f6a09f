"""Secret scan with multipart credential linking (DataFrame functions only).

Strong parts are reported wherever they stand: values assigned to a secret's name, access identifiers, long hex strings.
Weak parts (client identifiers, opaque 40-character strings, endpoints) mean little alone.  They are joined with the
other parts of the same text by interval: parts of complementary roles (identifier, secret, endpoint) link when the gap
between them is at most ``reach`` code points and no blank line parts their scopes.  A weak part is reported only when linked.

The join is a sweep over the text's parts in order of place, forward and back, holding the last part of each role:
linear in the parts, and no pairs are made.

Defined cases: null text is empty and has no spans; repeated rows are scanned one by one; offsets are code points with
exclusive ends; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPAN, as_given, match_spans, scan, set_apart

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CLIENT = r"""(?i)(client|access|account|user)[_-]?(id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{6,}"""
OPAQUE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s"'<>]*)?"""
#: kind, role, order in the listing, weak
KINDS = (
    ("assign", "secret", 0, False),
    ("access", "identifier", 1, False),
    ("hex", "secret", 2, False),
    ("client", "identifier", 3, True),
    ("opaque", "secret", 4, True),
    ("endpoint", "endpoint", 5, True),
)
ROLES = ("identifier", "secret", "endpoint")
REACH = 200
ONE = "struct<s:int,k:int,e:int,kind:string,role:string,weak:boolean,scope:int,linked:boolean>"
PART = f"array<{ONE}>"


def _parts(kind: str, spans: Column) -> Column:
    _, role, k, weak = next(x for x in KINDS if x[0] == kind)
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"),
            F.lit(role).alias("role"), F.lit(weak).alias("weak"), F.lit(0).alias("scope"), F.lit(False).alias("linked"),
        ),
    ).cast(PART)


def _sweep(parts: Column, reach: int, back: bool) -> Column:
    """Mark parts that a complementary part precedes (``back``: follows) within reach and in the same scope."""
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("scope"))
    start = F.struct(*[none.alias(r) for r in ROLES])

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        near = F.lit(False)
        for r in ROLES:
            gap = (held[r]["at"] - x["e"]) if back else (x["s"] - held[r]["at"])
            near = near | ((x["role"] != r) & F.coalesce((gap <= reach) & (held[r]["scope"] == x["scope"]), F.lit(False)))
        here = F.struct((x["s"] if back else x["e"]).alias("at"), x["scope"].alias("scope"))
        better = F.least if back else F.greatest
        then = [
            F.when(
                x["role"] == r,
                F.when(held[r]["at"].isNull() | (held[r]["scope"] != x["scope"]), here).otherwise(
                    F.struct(better(held[r]["at"], here["at"]).alias("at"), x["scope"].alias("scope"))
                ),
            )
            .otherwise(held[r])
            .alias(r)
            for r in ROLES
        ]
        return F.struct(*then), x.withField("linked", x["linked"] | near).cast(ONE)

    out = scan(F.reverse(parts) if back else parts, start, ONE, step)
    return F.reverse(out) if back else out


def _scoped(parts: Column, ends: Column) -> Column:
    """``parts`` with the number of blank lines before each, without weak ones that lie inside a strong one.

    A part inside a strong one is that part again, not a complement to it.  One pass over parts and ends in order.
    """
    mark = F.struct(*[F.lit(v).alias(n) for n, v in (("s", 0), ("k", -1), ("e", 0), ("kind", ""), ("role", ""), ("weak", True), ("scope", 0), ("linked", False))])
    both = F.array_sort(F.concat(parts, F.transform(ends, lambda x: mark.withField("s", x["e"]).cast(ONE))))

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        scope = held["scope"] + F.when(x["k"] < 0, 1).otherwise(0)
        strong = F.when(~x["weak"], F.greatest(held["strong"], x["e"])).otherwise(held["strong"])
        again = (x["k"] < 0) | (x["weak"] & (x["e"] <= held["strong"]))
        out = x.withField("scope", scope).withField("k", F.when(again, -1).otherwise(x["k"]))
        return F.struct(scope.alias("scope"), strong.alias("strong")), out.cast(ONE)

    out = scan(both, F.struct(F.lit(0).alias("scope"), F.lit(-1).alias("strong")), ONE, step)
    return F.filter(out, lambda x: x["k"] >= 0)


def scan_secrets(df: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``df`` plus ``parts``: array of (s, k, e, kind, role, weak, scope, linked), strong ones and linked weak ones.

    Where ``df`` has a column of that name, the new one is ``parts_1``, or the next that is free.
    """
    free = next(name for name in ("parts", *(f"parts_{n}" for n in range(1, len(df.columns) + 2))) if name.lower() not in map(str.lower, df.columns))
    df, own = set_apart(df)
    found = _with_parts(df, own[text_col], reach)
    return as_given(found.withColumnRenamed("parts", free), own)


def _with_parts(df: DataFrame, text_col: str, reach: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.regexp_like(text, F.lit(r"(?i)passw|secret|token|api_?key"))
    none = F.array().cast(f"array<{SPAN}>")
    value = F.regexp_extract
    df = df.withColumns(
        {
            "_assign": F.filter(
                F.when(named, match_spans(text, ASSIGN)).otherwise(none),
                lambda x: F.char_length(value(x["m"], ASSIGN, 2)) >= 12,
            ),
            "_access": F.when(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS)).otherwise(none),
            "_hex": match_spans(text, HEX),
            "_client": match_spans(text, CLIENT),
            "_opaque": match_spans(text, OPAQUE),
            "_endpoint": F.when(F.contains(text, F.lit("://")), match_spans(text, ENDPOINT)).otherwise(none),
        }
    )
    parts = F.concat(*[_parts(kind, F.col(f"_{kind}")) for kind, *_ in KINDS])
    df = df.withColumn("_all", F.array_sort(parts)).drop(*[f"_{kind}" for kind, *_ in KINDS])
    company = F.exists("_all", lambda x: x["weak"]) & (F.size("_all") > 1)
    scoped = _scoped(F.col("_all"), match_spans(text, r"\n[\x20\t]*\n"))
    df = df.withColumn("_scoped", F.when(company, scoped))
    linked = _sweep(_sweep(F.col("_scoped"), reach, False), reach, True)
    df = df.withColumn("_linked", F.when(F.col("_scoped").isNotNull(), linked).otherwise(F.col("_all")))
    return df.withColumn("parts", F.filter("_linked", lambda x: ~x["weak"] | x["linked"])).drop("_all", "_scoped", "_linked")


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan_secrets(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter("parts", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("parts", lambda x: ~x["weak"])
    return found.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("parts")).alias("spans"),
        F.size(F.filter("parts", lambda x: x["linked"])).cast("long").alias("n_linked"),
    )
