"""Secret scan with multipart credential linking, in DataFrame functions alone.

Base kinds are found row by row: `assign` (a keyword, a separator, a value), `access` (AKIA
identifiers) and `hex` (long hexadecimal runs).  The weak kinds `ident` (user or account names),
`weak` (long mixed tokens) and `endpoint` (URLs) mean nothing alone.  They are reported only where
complementary parts lie within one scope of each other: identifiers (access, ident) are
interval-joined with secrets (assign, hex, weak), and endpoints with the secrets so linked.

The interval join is an equality join on (document, cell of `scope` characters): a span that begins
at most `scope` behind another's end has its start in the cell of that end or in the next one, so
each part stands in a fixed number of cells, however long it is.  Spans of a kind do not overlap and
have a least length, so a cell holds a bounded number of starts and ends, and the pairs grow with the
text, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the runs of HEX that are long enough, looked for at their starts only
LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}"
IDENT = r"""([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
WEAK = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}"
# A scheme begins at the first letter of a run of its characters.  The run is matched from its start, or every
# letter in a long run without an endpoint would be followed to the run's end; what stands before the letter is SCHEME_LEAD.
ENDPOINT = r"""(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D"'<>]+"""
SCHEME_LEAD = "^[0-9+.-]*"

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
IDENTIFIERS, SECRETS, WEAK_KINDS = ("access", "ident"), ("assign", "hex", "weak"), ("ident", "weak", "endpoint")
RUN = 256  # matches that are collected in one list
SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"


def may_assign(text: Column) -> Column:
    """A text without a separator has neither assign nor ident spans."""
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))


def may_run(text: Column) -> Column:
    """A text without such a run has neither hex nor weak spans; one pass serves both."""
    return text.rlike(LONG_RUN)


def spans(text: Column, pattern: str, kind: str, possible: Column, keep=None, lead: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches that keep(match) accepts, in code points.

    What `lead` matches at a match's start is not part of its span.

    `possible` is a cheaper condition that every text with a match meets; others are not searched.

    The stretches between matches come from splitting at the pattern; their lengths and those of
    the matches add up to the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        first = begin if lead is None else begin + F.length(F.regexp_extract(part["match"], lead, 0))
        span = F.array(F.struct(first.alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), end.alias("end")))
        wanted = part["match"].isNotNull() if keep is None else part["match"].isNotNull() & keep(part["match"])
        return F.struct(end.alias("at"), F.when(wanted, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    def walk(parts: Column) -> Column:
        # Appending copies the list so far, so matches are collected in runs and the runs joined at the end.
        def run(state: Column, first: Column) -> Column:
            own = F.aggregate(F.slice(parts, first, RUN), F.struct(state["at"].alias("at"), none.alias("found")), step)
            return F.struct(own["at"].alias("at"), F.concat(state["found"], F.array(own["found"])).alias("found"))

        return F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(RUN)), start, run, lambda s: F.flatten(s["found"]))

    none = F.expr(f"cast(array() as {SPAN})")
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("found"))
    # The last stretch has no match. As a lambda's variable the parts are made once, not once a run.
    parts = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(possible, F.transform(F.array(parts), walk)[0]).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(
        spans(text, ASSIGN, "assign", may_assign(text), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        spans(text, ACCESS, "access", F.contains(text, F.lit("AKIA")), lambda m: F.length(m) >= 20),
        spans(text, LONG_HEX, "hex", may_run(text)),
    )


def weak_spans(text: Column) -> Column:
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.concat(
        spans(text, IDENT, "ident", may_assign(text), lambda m: F.length(F.regexp_extract(m, IDENT, 3)) >= 3),
        spans(text, WEAK, "weak", may_run(text), mixed),
        spans(text, ENDPOINT, "endpoint", F.contains(text, F.lit("://")), lead=SCHEME_LEAD),
    )


def _within(a: str, b: str, scope: int) -> Column:
    """The two spans do not overlap and at most `scope` characters lie between them."""
    gap = F.greatest(F.col(f"{b}_start") - F.col(f"{a}_end"), F.col(f"{a}_start") - F.col(f"{b}_end"))
    return (gap >= 0) & (gap <= scope)


def _side(parts: DataFrame, kinds: tuple, name: str, scope: int, spread: bool) -> DataFrame:
    """Spans of these kinds by the cells of their two ends; a spread one also stands in the next cell outwards.

    ahead says that the partner begins behind this side's spread spans (else it ends before them).
    """
    cell = lambda c: F.floor(F.col(c) / scope)
    place = lambda ahead, c: F.struct(F.lit(ahead).alias("ahead"), c.cast("long").alias("cell"))
    if spread:
        places = F.array(place(True, cell("end")), place(True, cell("end") + 1), place(False, cell("start")), place(False, cell("start") - 1))
    else:
        places = F.array(place(True, cell("start")), place(False, cell("end")))
    own = parts.filter(F.col("kind").isin(*kinds)).withColumn("at", F.explode(places))
    fields = [F.col("at.ahead").alias(f"{name}_ahead"), F.col("at.cell").alias(f"{name}_cell")]
    return own.select(F.col("key").alias(f"{name}_key"), *fields, *[F.col(c).alias(f"{name}_{c}") for c in ("start", "place", "kind", "end")])


def link_parts(parts: DataFrame, scope: int) -> DataFrame:
    """(key, start, place, kind, end) of the weak spans that stand near their complements."""

    def join(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
        same = [F.col(f"{a}_{c}") == F.col(f"{b}_{c}") for c in ("key", "ahead", "cell")]
        return left.join(right, same[0] & same[1] & same[2] & _within(a, b, scope))

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(f"{name}_key").alias("key"), *[F.col(f"{name}_{c}").alias(c) for c in ("start", "place", "kind", "end")])

    pairs = join(_side(parts, IDENTIFIERS, "i", scope, True), "i", _side(parts, SECRETS, "s", scope, False), "s")
    secrets = part(pairs, "s").distinct()
    ends = join(_side(parts, ("endpoint",), "e", scope, True), "e", _side(secrets, SECRETS, "s", scope, False), "s")
    linked = part(pairs, "i").unionByName(secrets).unionByName(part(ends, "e"))
    return linked.filter(F.col("kind").isin(*WEAK_KINDS)).distinct()


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 128) -> DataFrame:
    """df with `base_spans` and `all_spans`, arrays of (start, place, kind, end) by start, then kind.

    A null text has no spans.  Rows with equal id and text get equal results and are all kept, also
    where the id is null.  Existing columns with these two names are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in ("base_spans", "all_spans")]
    key, text, other = (fresh_name(df.columns, n) for n in ("span_key", "span_text", "span_links"))
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = df.select(*[F.col(f"`{c}`") for c in kept], body.alias(text)).withColumn(
        key, F.md5(F.encode(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(":"), F.col(text)), "UTF-8"))
    )
    base = keyed.withColumn("base_spans", F.array_sort(base_spans(F.col(text))))
    # A link needs an identifier, a secret and a weak span to report; the identifier and the secret may both be base spans.
    identifier = F.contains(F.col(text), F.lit("AKIA")) | F.col(text).rlike(IDENT)
    weak = keyed.filter((may_run(F.col(text)) | may_assign(F.col(text))) & identifier).select(F.col(key).alias("key"), F.col(text).alias("t")).withColumn("w", weak_spans(F.col("t")))
    both = weak.filter(F.size("w") > 0).select("key", F.concat("w", base_spans(F.col("t"))).alias("all"))
    # Both joins read the parts several times; written once, the texts are searched once for them.  Rows with equal
    # keys have equal parts, and one copy of each is enough: all of them would meet all.
    parts = materialize(both.select("key", F.explode("all").alias("p")).select("key", "p.*").distinct())
    linked = link_parts(parts, scope).groupBy("key").agg(F.collect_list(F.struct("start", "place", "kind", "end")).alias(other))
    joined = base.join(linked.withColumnRenamed("key", f"{key}_right"), F.col(key) == F.col(f"{key}_right"), "left")
    spans_all = F.array_sort(F.concat("base_spans", F.coalesce(F.col(other), F.expr(f"cast(array() as {SPAN})"))))
    return joined.withColumn("all_spans", spans_all).select(*[F.col(f"`{c}`") for c in kept], "base_spans", "all_spans")


def span_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 128, mark: str = "[SECRET]") -> DataFrame:
    """df with every reported span of the text replaced by the mark; overlapping spans by one mark."""
    names = df.columns
    found = scan_secrets(df, id_col, text_col, scope)
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("all_spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("all_spans") > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in names])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, with the weak parts that complete a credential."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(span_text("base_spans"), "UTF-8"), 256).alias("base_sha256"), span_text("all_spans").alias("spans"))
