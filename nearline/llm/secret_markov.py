"""Secret scan: fixed patterns, and Markov models of characters for what they miss.

Everything runs in DataFrame and SQL functions.  Positions come from splitting a
text at its matches: the lengths of the pieces and of the matches add up to the
start of each match, in code points.  The sums are taken in blocks of matches,
so their cost stays linear in practice for texts with very many matches.

The models are tables of character transitions: one for each alphabet that
secrets are written in, counted on random strings drawn from it, and one of ordinary
identifiers, counted on the corpus's own words, alone and joined as identifiers
are, on a bounded sample of documents.  A token is a secret when, for some
alphabet, the mean log-likelihood ratio of its transitions, random over
ordinary, exceeds a threshold.  Half of the samples are held out; they set the threshold
and measure recall by alphabet and false positives.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearline.session import materialize

#: The patterns of the three kinds (keywords in either case) and their least lengths.
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")
#: A run of the hex or access class shorter than the least length can't pass and can't hide a longer one.
SEARCHED = {"assign": ASSIGN, "access": f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "hex": f"[0-9a-f]{{{LEAST['hex']},}}"}
ASSIGN_END = "[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"
TOKEN = "[A-Za-z0-9_+/-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-"
#: Alphabets of random strings.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
RANDOM = {"hex": DIGITS + "abcdef", "upper_hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "lower_digits": LOWER + DIGITS,
          "base62": UPPER + LOWER + DIGITS, "base64url": UPPER + LOWER + DIGITS + "_-", "base64": UPPER + LOWER + DIGITS + "+/"}
ORDINARY = "ordinary"
BLOCK = 256
SPAN = "array<struct<start:int,end:int,kind:int,text:string>>"


def _spans(df: DataFrame, out: str, pattern: str, kind: int, keep, maybe: Column | None = None) -> DataFrame:
    """Adds array column ``out`` of the kept matches of ``pattern`` in ``__text``.

    ``maybe`` is a cheap test that every text with a kept match meets.
    """
    found = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
    df = df.withColumn("__found", found if maybe is None else F.when(maybe, found).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.withColumn("__pieces", F.when(F.exists("__found", keep), F.split("__text", pattern, -1)))
    steps = F.transform("__found", lambda m, i: F.length(F.get("__pieces", i)) + F.length(m))
    df = df.withColumn("__steps", F.when(F.col("__pieces").isNotNull(), steps))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__steps") - 1) / BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice("__steps", b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
    df = df.withColumn("__blocks", F.when(F.col("__steps").isNotNull(), blocks))

    def place(m, i):
        b = F.floor(i / BLOCK).cast("int")
        add = lambda a, x: a + x
        end = (F.aggregate(F.slice("__blocks", F.lit(1), b), F.lit(0), add)
               + F.aggregate(F.slice("__steps", b * BLOCK + 1, i - b * BLOCK + 1), F.lit(0), add))
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("text"))

    spans = F.filter(F.transform("__found", place), lambda s: keep(s["text"]))
    df = df.withColumn(out, F.when(F.col("__blocks").isNotNull(), spans).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return df.drop("__found", "__pieces", "__steps", "__blocks")


def _base(df: DataFrame) -> DataFrame:
    """Adds the spans of the fixed patterns and ``__tokens``, the runs of token characters.

    Kept access and hex matches lie inside such runs, and a kept assignment ends
    in a sign, spaces, a quote and six value characters, so most texts are
    searched for two simple patterns only.
    """
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    df = df.withColumn("__tokens", F.regexp_extract_all("__text", F.lit(TOKEN), F.lit(0)))
    inside = lambda pattern: F.exists("__tokens", lambda t: F.rlike(t, F.lit(pattern)))
    df = _spans(df, "__assign", SEARCHED["assign"], 0, lambda m: value(m) >= LEAST["assign"], F.rlike("__text", F.lit(ASSIGN_END)))
    df = _spans(df, "__access", SEARCHED["access"], 1, lambda m: F.length(m) >= LEAST["access"], inside(SEARCHED["access"]))
    return _spans(df, "__hex", SEARCHED["hex"], 2, lambda m: F.length(m) >= LEAST["hex"], inside(SEARCHED["hex"]))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios, random over ordinary, of each transition: row after row of ALPHABET, one table after another."""

    ratios: tuple[float, ...]
    threshold: float
    recall: dict[str, float]  # of held-out random strings, by alphabet
    false_positives: float  # share of held-out ordinary identifiers above the threshold

    def score(self, token: Column) -> Column:
        """Largest mean ratio of the token's transitions over the tables; its characters lie in ALPHABET."""
        n = len(ALPHABET)
        codes = {ord(c): i for i, c in enumerate(ALPHABET)}
        place = F.expr("cast(split('" + ",".join(str(codes.get(i, 0)) for i in range(128)) + "', ',') as array<int>)")
        table = F.expr("cast(split('" + ",".join(f"{x:.4f}" for x in self.ratios) + "', ',') as array<double>)")
        at = F.transform(F.split(token, ""), lambda c: F.get(place, F.ascii(c)))
        pairs = F.zip_with(F.slice(at, F.lit(1), F.length(token) - 1), F.slice(at, F.lit(2), F.length(token) - 1), lambda a, b: a * n + b)
        tables = F.sequence(F.lit(0), F.lit(len(self.ratios) // (n * n) - 1))
        total = lambda p, t: F.aggregate(p, F.lit(0.0), lambda a, x: a + F.get(table, t * (n * n) + x))
        # The pairs stand in an array of one, so that they are computed once for all tables.
        best = F.transform(F.array(pairs), lambda p: F.array_max(F.transform(tables, lambda t: total(p, t))))
        return F.get(best, F.lit(0)) / (F.length(token) - 1)


def random_strings(spark, strings: int, shortest: int = 20, longest: int = 64) -> DataFrame:
    """(label, id, token): ``strings`` random strings of each alphabet, lengths spread evenly; the same on every call."""
    names = list(RANDOM)
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("kind"))
    rows = spark.range(len(names) * strings).select("id", F.pmod("id", F.lit(len(names))).cast("int").alias("kind"))
    size = F.lit(shortest) + F.pmod(F.xxhash64(F.lit(21), "id"), F.lit(longest - shortest + 1)).cast("int")
    rows = rows.select("id", at(names).alias("label"), at(RANDOM.values()).alias("letters"), size.alias("size"))
    draw = F.transform(F.expr("sequence(1, size)"), lambda j: F.substring(
        F.col("letters"), F.pmod(F.xxhash64(F.lit(22), F.col("id"), j), F.length("letters")).cast("int") + 1, F.lit(1)))
    return rows.select("label", "id", F.array_join(draw, "").alias("token"))


def identifiers(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(label, id, token) of about ``sample_docs`` documents (those of least id hash): words of three in a row, joined as identifiers are.

    Joints are _ - / nothing with capitals, a number behind the last; two of ten are
    numbers only and rulers (one sign or two in turn).  Words that the fixed patterns take for random strings are left out.
    """
    rows = docs.count()
    limit = int(-(2**63) + 2**64 * min(1.0, sample_docs / max(1, rows))) - 1
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sample = docs.where(F.xxhash64(F.lit(5), F.col(f"`{id_col}`")) <= F.lit(limit)).select(
        F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}|[A-Za-z0-9]{3,}"), F.lit(0)).alias("words"))
    plain = F.filter("words", lambda w: ~(F.rlike(w, F.lit(SEARCHED["hex"])) | F.rlike(w, F.lit(SEARCHED["access"]))
                                          | (F.rlike(w, F.lit("[0-9]")) & F.rlike(w, F.lit("[A-Za-z]")) & (F.length(w) >= 12))))
    sample = sample.select(plain.alias("words")).where(F.size("words") > 0)
    threes = F.expr("transform(sequence(0, (size(words) - 1) div 3), i -> slice(words, 3 * i + 1, 3))")
    # Hash of the three words, so that a sample does not depend on row numbers.
    threes = sample.select(F.explode(threes).alias("w")).withColumn("id", F.xxhash64("w"))
    number = F.lpad(F.pmod("id", F.lit(10_000)).cast("string"), 4, "0")
    digits = F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("string"), 9, "0")
    camel = F.array_join(F.transform("w", F.initcap), "")
    kinds = [F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), camel, F.concat(camel, number),
             F.concat(F.array_join("w", "_"), F.lit("_"), number), F.array_join(F.transform("w", F.upper), "_"),
             F.concat_ws("-", digits, number, digits),
             F.repeat(F.substring(F.lit(ALPHABET), F.pmod("id", F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)), F.lit(24)),
             F.repeat(F.substring(F.lit("_-_/-+/_+-"), F.pmod("id", F.lit(9)).cast("int") + 1, F.lit(2)), F.lit(12))]
    return threes.select(F.lit(ORDINARY).alias("label"), "id", F.get(F.array(*kinds), F.pmod(F.shiftright("id", 20), F.lit(len(kinds))).cast("int")).alias("token"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, strings: int = 4000,
          least: float = 0.1, smoothing: float = 0.5) -> MarkovModel:
    """Count transitions on half of the labelled samples; the other half sets the threshold.

    It lies halfway between the ordinary score that one in a thousand exceeds and the
    lowest, over alphabets, that nineteen of twenty random strings exceed, ``least`` at least.
    Without ordinary identifiers (an empty table) their model is uniform, which strings over all
    characters hardly exceed.
    """
    spark = docs.sparkSession
    labelled = random_strings(spark, strings).union(identifiers(docs, id_col, text_col, sample_docs))
    # Stored: its columns are used inside functions of others, where they must not be computed again.
    labelled = materialize(labelled.withColumn("held", F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(2)) == 0), "secret-sample")
    letters = F.split("token", "")
    steps = labelled.where("not held").select("label", F.explode(F.zip_with(
        F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1),
        lambda a, b: F.concat(a, b))).alias("step"))
    counts = {(r["label"], r["step"][0], r["step"][1]): r["count"] for r in steps.groupBy("label", "step").count().collect()}
    rowsum: dict[tuple, int] = {}
    for (label, a, _), c in counts.items():
        rowsum[label, a] = rowsum.get((label, a), 0) + c
    n = len(ALPHABET)
    prob = lambda l, a, b: (counts.get((l, a, b), 0) + smoothing) / (rowsum.get((l, a), 0) + smoothing * n)
    ordinary = {(a, b): prob(ORDINARY, a, b) for a in ALPHABET for b in ALPHABET}
    ratios = tuple(log(prob(l, a, b) / ordinary[a, b]) for l in RANDOM for a in ALPHABET for b in ALPHABET)
    held = materialize(labelled.where("held and length(token) >= 20").select(
        "label", MarkovModel(ratios, 0.0, {}, 0.0).score(F.col("token")).alias("s")), "secret-held")
    cuts = {r["label"]: (r["low"], r["high"]) for r in held.groupBy("label").agg(
        F.percentile("s", 0.05).alias("low"), F.percentile("s", 0.999).alias("high")).collect()}
    low = min(cuts[l][0] for l in RANDOM)
    threshold = max(least, (low + min(low, cuts[ORDINARY][1] if ORDINARY in cuts else 0.0)) / 2)
    over = {r["label"]: r["share"] for r in held.groupBy("label").agg(F.avg((F.col("s") > threshold).cast("double")).alias("share")).collect()}
    return MarkovModel(ratios, threshold, {l: over[l] for l in RANDOM}, over.get(ORDINARY, 0.0))


def scan(docs: DataFrame, model: MarkovModel, text_col: str = "text") -> DataFrame:
    """Every input column and ``secret_spans``: (start, end, kind, text) by start, then kind (see KINDS).

    Starts and ends count code points, end exclusive; kinds 0 to 2 are the fixed
    patterns, 3 the tokens that the model adds outside of them.  A null or empty
    text has no spans.  An input column named secret_spans is replaced; rows are
    independent, so ids may be null or repeated.  Empty tables give no rows.
    """
    names = [c for c in docs.columns if c != "secret_spans"]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    df = _base(df)
    random = lambda m: model.score(m) > model.threshold
    df = _spans(df, "__token", TOKEN, 3, random, F.exists("__tokens", random))
    base = F.concat("__assign", "__access", "__hex")
    df = df.withColumn("__base", base)
    added = F.filter("__token", lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.array_sort(F.transform(F.concat("__base", added), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"))))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return df.select(*[F.col("__row").getField(c).alias(c) for c in names], spans.alias("secret_spans"))


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replaces what ``secret_spans`` covers by ``mask`` (overlapping spans by one) and drops that column.

    A null text stays null, an empty one empty; rows are independent, so ids may be
    null or repeated, and other columns may have any name.  Empty tables give no rows.
    """
    merged = F.aggregate(
        "secret_spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, F.lit(-1))["end"] > s["start"]),
                              F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, F.lit(-1))["start"].alias("start"),
                                  F.greatest(F.element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    text = F.col(f"`{text_col}`")

    def masked(cuts):
        pieces = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.substring(
            text, F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"]) + 1,
            F.when(i == F.size(cuts), F.length(text)).otherwise(F.get(cuts, i)["start"])
            - F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])))
        return F.when(F.size(cuts) > 0, F.array_join(pieces, mask)).otherwise(text)

    # The merged spans are bound once: a filter on the text, which the plan moves below, would repeat them for each use.
    done = F.get(F.transform(F.array(merged), masked), F.lit(0))
    return found.withColumn(text_col, done).drop("secret_spans")
