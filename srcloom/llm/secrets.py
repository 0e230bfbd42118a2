"""Secret scans with DataFrame functions only: base patterns, and character Markov models.

Base kinds and their patterns are fixed values.  Their matches are found left to right without
overlap; a match that is too short is dropped after it has taken its place.  Places follow from the
lengths of what ``split`` leaves between the matches.  Matches are gone through in blocks of ``BLOCK``, as an
array can only be grown by copying it: a text of n matches costs n x BLOCK + (n / BLOCK)^2 steps, and one
that is masked is read once for each block, not for each span.

The method.  Two first-order Markov models of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples: random are the values that base patterns find and
base64 and hexadecimal digests; ordinary are the other words of sampled documents
that look like identifiers, and runs of one character.  The sample is
bounded (``sample_docs``, by a share that follows from the exact number of rows and isn't 0; ``digests``).  A run of
at least ``LEAST`` token characters is cut at base spans, and what is left of it in one piece is a secret
if it has so many characters and its mean log-likelihood ratio per step is above ``RATIO``; of a piece that
isn't, the parts between ``=``, and of those that aren't the parts between all separators, are judged by
themselves.  A model is a table of 66 x 66 numbers, whatever the input.

Defined results: null and empty texts have no spans and keep their rows; texts of any length are scanned
whole; repeated rows have equal spans; of spans that start together kinds stand in the order assign, access, hex, markov; an empty
table gives no rows; in ``masked`` all other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.arrays import BLOCK, running
from srcloom.llm.langid import SHARES, share_of

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
# The method's.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, RATIO, SAMPLE_DOCS, DIGESTS = 20, 0.6, 2000, 2000
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
#: What a word must look like to be labelled ordinary: words of letters, with a short number at the end.
#: Possessive, as a repeated group that may give back takes a stack frame of the JVM for each turn.
ORDINARY = r"^[A-Za-z]++(?:[-_=+/][A-Za-z]++)*+\d{0,4}$"
SEPARATORS = ("=", "[/+=_-]")
PART = "array<struct<start:int,end:int,token:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _matches(text: F.Column, pattern: str) -> F.Column:
    """A pattern's matches with the lengths of what stands before each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), m.alias("token")))


def _found(text: F.Column, pattern: str, rank: int, kind: str, group: bool = False) -> F.Column:
    """Spans of a pattern's matches; with group, of those whose group is long enough."""

    def step(at, x):
        a, z = at + x["gap"], at + x["gap"] + x["len"]
        own = F.array(F.struct(a.alias("start"), F.lit(rank).alias("rank"), z.alias("end"), F.lit(kind).alias("kind")))
        return z, F.when(F.length(F.regexp_extract(x["token"], pattern, 1)) >= LEAST_VALUE, own).otherwise(F.array().cast(SPAN)) if group else own

    return F.when(text.rlike(pattern), running(_matches(text, pattern), F.lit(0), SPAN, step)).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base``, the base patterns' spans in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("base", F.array_sort(F.concat(_found(t, ASSIGN, 0, "assign", True), _found(t, ACCESS, 1, "access"), _found(t, HEX, 2, "hex"))))


def _codes(token: F.Column) -> F.Column:
    """Places of a string's characters in ALPHABET, from 0."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _steps(token: F.Column) -> F.Column:
    """Numbers of a string's steps from character to character: a place in the model's table each."""
    codes = _codes(token)
    n = F.size(codes)
    return F.zip_with(F.slice(codes, 1, F.greatest(n - 1, F.lit(0))), F.slice(codes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, digests: int = DIGESTS) -> DataFrame:
    """(random boolean, token) from a bounded sample of documents and from digests."""
    share = share_of(sample_docs, docs.count())
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < share).select(F.coalesce("text", F.lit("")).alias("text"))
    values = some.where(F.col("text").rlike(ASSIGN)).select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).alias("token")).where(F.length("token") >= LEAST)
    words = some.where(~F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token")).where(F.col("token").rlike(ORDINARY))
    # rules and fillers of one character are ordinary too
    runs = docs.sparkSession.range(1).select(F.explode(F.filter(F.split(F.lit(ALPHABET), ""), lambda c: c != "")).alias("c")).select(F.repeat("c", F.lit(50)).alias("token"))
    words = words.unionByName(runs)
    ids = docs.sparkSession.range(digests).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    made = ids.select(F.explode(F.array(F.substring("hex", 1, 40), F.base64(F.unhex("hex")))).alias("token"))
    return values.unionByName(made).withColumn("random", F.lit(True)).unionByName(words.withColumn("random", F.lit(False))).select("random", "token")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all steps, random against ordinary, from rows (random, token)."""
    k = len(ALPHABET)
    clean = samples.where(F.col("token").isNotNull()).select("random", F.explode(_steps(F.regexp_replace("token", r"[^A-Za-z0-9+/_=-]", ""))).alias("step"))
    count = {(r["random"], r["step"]): r["n"] for r in clean.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(k):
        total = {x: sum(count.get((x, a * k + b), 0) for b in range(k)) + k for x in (True, False)}
        for b in range(k):
            p = {x: (count.get((x, a * k + b), 0) + 1) / total[x] for x in (True, False)}
            out.append(math.log(p[True] / p[False]))
    return out


def _part(start: F.Column, end: F.Column, token: F.Column) -> F.Column:
    """A part as an array of one, if it is long enough."""
    own = F.array(F.struct(start.alias("start"), end.alias("end"), token.alias("token"))).cast(PART)
    return F.when(end - start >= LEAST, own).otherwise(F.array().cast(PART))


def _outside(c: F.Column, base: F.Column) -> F.Column:
    """Parts of a candidate that no base span holds."""
    part = lambda a, z: _part(a, z, c["token"].substr(a - c["start"] + 1, z - a))
    over = F.filter(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    last = F.struct(c["end"].alias("start"), c["end"].alias("end"))
    ends = F.concat(F.transform(over, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))), F.array(last))
    return F.when(F.size(over) > 0, running(ends, c["start"], PART, lambda at, b: (F.greatest(at, b["end"]), part(at, b["start"])))).otherwise(F.array(c).cast(PART))


def _between(c: F.Column, separator: str) -> F.Column:
    """Parts of a candidate between separators of one character; none where it has no separator."""
    parts = running(F.split(c["token"], separator, -1), c["start"], PART, lambda at, x: (at + F.length(x) + 1, _part(at, at + F.length(x), x)))
    return F.when(c["token"].rlike(separator), parts).otherwise(F.array().cast(PART))


def _by_block(items: F.Column, each) -> F.Column:
    """each(block) of an array's blocks, flattened."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))
    return F.flatten(F.transform(blocks, each))


def markov_spans(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """Adds ``added``, spans that the models call random, of what candidates have outside ``base``."""
    t = F.coalesce(F.col(text), F.lit(""))
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")

    def place(at, x):
        z = at + x["gap"] + x["len"]
        return z, F.array(F.struct((at + x["gap"]).alias("start"), z.alias("end"), x["token"].alias("token"))).cast(PART)

    placed = F.when(t.rlike(CANDIDATE), running(_matches(t, CANDIDATE), F.lit(0), PART, place)).otherwise(F.array().cast(PART))

    def free(block):
        first, last = block[0]["start"], F.element_at(block, -1)["end"]
        near = F.filter("base", lambda b: (b["start"] < last) & (b["end"] > first))
        # by way of an array, so that the filter runs once for the block
        return F.flatten(F.transform(F.array(near), lambda base: F.flatten(F.transform(block, lambda c: _outside(c, base)))))

    def ratio(token):
        return F.aggregate(F.transform(_steps(token), lambda s: F.element_at(ratios, s + 1)), F.lit(0.0), lambda acc, v: acc + v) / F.greatest(F.length(token) - 1, F.lit(1))

    random = lambda c: ratio(c["token"]) > RATIO
    by_name = lambda c: F.when(random(c), F.array(c)).otherwise(F.filter(_between(c, SEPARATORS[1]), random))
    # without "=" the part is the piece itself
    pieces = lambda c: F.when(c["token"].contains(SEPARATORS[0]), F.flatten(F.transform(_between(c, SEPARATORS[0]), by_name))).otherwise(F.filter(_between(c, SEPARATORS[1]), random))
    hits = F.flatten(F.transform(_by_block(F.col("_placed"), free), lambda c: F.when(random(c), F.array(c)).otherwise(pieces(c))))
    spans = F.transform(hits, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.lit("markov").alias("kind")))
    return docs.withColumn("_placed", placed).withColumn("added", F.when(F.size("_placed") > 0, spans).otherwise(F.array()).cast(SPAN)).drop("_placed")


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """Adds base and added; trains on docs unless a table is given."""
    table = table or train(labelled_samples(docs.select("doc_id", "text")))
    return markov_spans(base_spans(docs), table)


def _listed(spans: str | F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, and all spans."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table).select("doc_id", "base", "added")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def masked(docs: DataFrame, mask: str = "[SECRET]", table: list[float] | None = None) -> DataFrame:
    """docs with every span replaced by ``mask`` and n_chars counted anew where the text has changed."""
    names = docs.columns
    table = table or train(labelled_samples(docs.select("doc_id", "text")))
    found = scan(docs.select(F.struct("*").alias("_row"), "text"), table).withColumn("_spans", F.array_sort(F.concat("base", "added")))
    # spans without what an earlier one holds, with the end of the one before
    fresh = running(F.col("_spans"), F.lit(0), "array<struct<from:int,to:int,end:int>>", lambda at, x: (F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(F.struct(at.alias("from"), x["start"].alias("to"), x["end"].alias("end")))).otherwise(F.array()).cast("array<struct<from:int,to:int,end:int>>")))

    def cut(block):
        a = block[0]["from"]
        own = F.col("text").substr(a + 1, F.element_at(block, -1)["to"] - a)  # the text is gone through once for a block
        return F.flatten(F.transform(F.array(own), lambda part: F.transform(block, lambda x: F.concat(part.substr(x["from"] - a + 1, x["to"] - x["from"]), F.lit(mask)))))

    last = F.aggregate("_spans", F.lit(0), lambda acc, x: F.greatest(acc, x["end"]))
    clean = F.concat(F.array_join(_by_block(F.col("_fresh"), cut), ""), F.col("text").substr(last + 1, F.length("text")))
    found = found.withColumn("_fresh", fresh)
    some = F.size("_spans") > 0
    out = found.withColumn("_text", F.when(some, clean).otherwise(F.col("text")))
    cols = {"text": F.col("_text").alias("text")}
    if "n_chars" in names:
        cols["n_chars"] = F.when(some, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return out.select(*(cols.get(c, F.col("_row")[c].alias(c)) for c in names))

