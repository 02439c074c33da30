"""Secret scan in SQL functions only: fixed patterns, and character Markov models for what they miss.

Two first-order Markov chains over a reduced alphabet (one class for each
ASCII letter, digit and token sign) are trained from labelled samples, one of
random strings and one of ordinary identifiers. A token of at least
``MIN_TOKEN`` characters with letters and digits is a finding of kind
``markov`` when the log-likelihood ratio of the two chains exceeds ``MIN_LLR``
in all and ``MIN_RATE`` per character.

Positions come from splitting the text at the matches: lengths of pieces and
matches add up to offsets in code points. Only texts with a match get there.
Building the list of one text's findings copies it once for each finding.

Defined cases: a null text counts as empty and has no finding; an empty table
gives an empty result; rows that repeat are scanned one by one. Other columns
are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base findings and how long a finding must be.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1
MIN_TOKEN, MAX_CLASSES = 20, 128
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_LLR, MIN_RATE = 12.0, 0.5

# Parts that ordinary identifiers of the training sample are made of.
PARTS = (
    "get set user name id list map key value count index file path data type size max min default config option request response "
    "handler service client server manager factory builder context session thread pool queue cache buffer stream reader writer "
    "parser node tree graph table column row field record query result error exception status state event listener update delete "
    "create insert select find search sort filter merge join split format print string number integer boolean array object class "
    "method function param return start stop open close read write load save init test main base common util helper model view "
    "controller page form input output image text color width height left right top bottom first last next previous current total "
    "version release build deploy docker cluster worker driver executor partition shuffle window schema catalog database storage "
    "message topic consumer producer offset commit branch origin master feature internal external public private static final http "
    "www example com org index html article section product category the and for with that this from have not are was under over "
    "information international development organisation communication responsible understanding performance environment"
).split()


def training_sample(spark: SparkSession, rows: int = 20_000) -> DataFrame:
    """Labelled strings, the same at each call: text, random (1 or 0). ``rows`` of each label."""
    base = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(digest))
    kind = F.col("id") % 4
    drawn = F.when(kind == 0, digest).when(kind == 1, F.upper(F.regexp_replace(b64, "[+/=a-z]", ""))).when(kind == 2, b64).otherwise(F.regexp_replace(b64, "[+/=]", ""))
    random = base.select(F.substring(drawn, 1, 40).alias("text"), F.lit(1).alias("random"))
    words = F.array(*map(F.lit, PARTS))

    def part(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))

    parts = [part(k) for k in range(4)]
    style = F.col("id") % 6
    plain = F.when(style == 0, F.concat_ws("_", *parts)).when(style == 1, F.concat(parts[0], *(F.initcap(p) for p in parts[1:]))).when(style == 2, F.concat(*map(F.initcap, parts)))
    plain = plain.when(style == 3, F.concat_ws("-", *parts)).when(style == 4, F.concat_ws("/", *parts)).otherwise(F.upper(F.concat_ws("_", *parts)))
    numbered = F.when(F.col("id") % 5 == 0, F.concat(plain, (F.col("id") % 2030).cast("string"))).otherwise(F.when(F.col("id") % 7 == 0, F.concat(*parts)).otherwise(plain))
    return random.unionByName(base.select(numbered.alias("text"), F.lit(0).alias("random")))


def train_markov(samples: DataFrame, text_col: str = "text", label_col: str = "random") -> list[float]:
    """Log-likelihood ratio of each transition, ``STATES`` rows of ``STATES``; add-half smoothing. Counts are summed on the executors."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = samples.select(F.col(label_col).alias("y"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).alias("pair"))
    state = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(STATES)) - 1
    counts = pairs.where(F.char_length("pair") == 2).groupBy("y", state(F.substring("pair", 1, 1)).alias("a"), state(F.substring("pair", 2, 1)).alias("b")).count()
    seen = {(r["y"], r["a"], r["b"]): r["count"] for r in counts.collect()}  # at most 2 * STATES * STATES rows

    def log_probability(y: int, a: int) -> list[float]:
        row = [seen.get((y, a, b), 0) + 0.5 for b in range(STATES)]
        return [math.log(x / sum(row)) for x in row]

    return [p - q for a in range(STATES) for p, q in zip(log_probability(1, a), log_probability(0, a), strict=True)]


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """Sum of the model's entries over the transitions of an ASCII ``token``."""
    table = F.lit(model)
    states = F.lit([ALPHABET.find(chr(c)) if chr(c) in ALPHABET else STATES - 1 for c in range(MAX_CLASSES)])
    codes = F.transform(F.split(token, ""), lambda c: F.get(states, F.ascii(c)))
    return F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(table, s["last"] * STATES + c), F.lit(0.0)))).alias("sum")),
        lambda s: s["sum"],
    )


def _spans(text: Column, pattern: str, kind: str, order: int, keep: Column | None = None) -> Column:
    """Array of (start, kind order, end, kind) of the leftmost non-overlapping matches. keep: an array of booleans beside them."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ok = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"), ok.alias("ok"))
    shape = "array<struct<start:int,kind_no:int,stop:int,kind:string>>"
    return F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out")),
        lambda s, r: F.struct(
            (s["at"] + F.char_length(r["p"]) + F.char_length(r["m"])).alias("at"),
            F.when(r["ok"], F.concat(s["out"], F.array(F.struct((s["at"] + F.char_length(r["p"])).alias("start"), F.lit(order).alias("kind_no"), (s["at"] + F.char_length(r["p"]) + F.char_length(r["m"])).alias("stop"), F.lit(kind).alias("kind")))))
            .otherwise(s["out"]).cast(shape).alias("out"),
        ),
        lambda s: s["out"],
    )


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text, findings as array of (start, kind_no, stop, kind), sorted by start, then kind."""
    text = F.col("_kf_text")
    none = F.array().cast("array<struct<start:int,kind_no:int,stop:int,kind:string>>")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_kf_text"))
    groups = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.char_length(g) >= ASSIGN_CHARS)
    keys = F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda g: F.char_length(g) >= ACCESS_CHARS)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    ratio = lambda t: likelihood_ratio(t, model)
    odd = F.transform(tokens, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (ratio(t) > F.greatest(F.lit(MIN_LLR), F.lit(MIN_RATE) * F.char_length(t))))
    parts = [
        F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, "assign", 0, groups)).otherwise(none),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, "access", 1, keys)).otherwise(none),
        F.when(text.rlike(HEX), _spans(text, HEX, "hex", 2)).otherwise(none),
        F.when(text.rlike(TOKEN), _spans(text, TOKEN, "markov", 3, odd)).otherwise(none),
    ]
    return rows.select(id_col, F.col("_kf_text").alias("text"), F.array_sort(F.concat(*parts)).alias("findings"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    say = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))
    joined = lambda fs: F.array_join(F.transform(fs, say), ",")
    number = lambda k: F.size(F.filter("findings", lambda f: f["kind_no"] == k)).cast("long")
    base = F.filter("findings", lambda f: f["kind_no"] < 3)
    return scanned.select(id_col, number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), number(3).alias("n_markov"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
