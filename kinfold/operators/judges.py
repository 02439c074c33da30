"""Text baselines: name overlap, TF-IDF cosine, keyword retrieval, recorded replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def text_surface(specs: DataFrame) -> DataFrame:
    """specs: id, name, description, family. id and its text; the only place where descriptions are read."""
    return specs.select("id", F.concat_ws(" ", "name", "description", "family").alias("text"))


def name_match(pairs: DataFrame, tau: float = 0.5) -> DataFrame:
    """pairs: a, b, name_a, name_b. score: Jaccard of the tokens of name and id."""
    ta, tb = (S.tokens(F.concat_ws(" ", f"name_{x}", F.col(x).cast("string"))) for x in "ab")
    return pairs.select("a", "b", S.jaccard(ta, tb).alias("score")).withColumn("mergeable", F.col("score") >= tau)


def name_blocks(rows: DataFrame, group: Sequence[str], tau: float = 0.5, least: int = 2048) -> DataFrame:
    """rows: id, text, group columns. Jaccard of the tokens of all texts of a group, by pairs of blocks: side, ids_a, ids_b, score, mergeable.

    A token that stands in one row of its group is in no intersection, so rows
    with the same other tokens and as many tokens have the same scores: a block
    is up to ``least`` of their ids, and a score is counted once for two blocks.
    Large groups go to several tasks. ``expanded`` lists the pairs of rows. As
    in SQL, a null text of the row with the smaller id makes the score null, and
    one of the other row makes it 0.
    """
    g = list(group)
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ("id", *g))).groupBy(*g, "id", S.tokens(F.col("text")).alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    each = known.select("*", F.explode_outer("tokens").alias("token"))
    common = each.groupBy(*g, "token").agg(F.sum("n").alias("_in")).where("_in > 1")
    kept = each.join(common, [*g, "token"], "left").groupBy(*g, "id", "tokens").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_in").isNotNull(), F.col("token")))).alias("shared"))
    alike = kept.groupBy(*g, F.array_size("tokens").alias("size"), "shared").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("id", F.col("n").cast("int"))))).alias("ids"))
    starts = F.sequence(F.lit(1), F.array_size("ids"), F.lit(least))
    blocks = alike.select(*g, "size", "shared", F.explode(F.transform(starts, lambda i: F.struct(F.slice("ids", i, F.lit(least)).alias("ids"), i.alias("at")))).alias("b"))
    blocks = blocks.select(*g, "shared", "b.ids", F.struct(F.get("b.ids", F.lit(0)).alias("id"), F.col("b.at").alias("at"), F.coalesce("size", F.lit(-1)).alias("size"), "shared").alias("key"), "size")
    parts = blocks.groupBy(*g).agg(F.ceil(F.sum(F.array_size("ids")) / (2 * least)).cast("int").alias("parts"))
    blocks = blocks.join(parts, g)
    x = blocks.select(*g, F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in ("ids", "key", "size", "shared")))
    y = blocks.select(*g, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in ("ids", "key", "size", "shared")))
    met = x.join(y, [*g, "part"]).where("key_a <= key_b")
    sides = F.when(F.col("key_a") == F.col("key_b"), F.array(F.lit(-1))).when(F.isnull("size_a") != F.isnull("size_b"), F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    met = met.select(F.explode(sides).alias("side"), "ids_a", "ids_b", "size_a", "size_b", F.array_size(F.array_intersect("shared_a", "shared_b")).alias("both"))
    first = F.when(F.col("side") > 0, F.col("size_b")).otherwise(F.col("size_a"))
    score = F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("size_a") + F.col("size_b") - F.col("both")), F.lit(0.0))
    return met.select("side", "ids_a", "ids_b", F.when(first.isNotNull(), score).alias("score")).withColumn("mergeable", F.col("score") >= tau)


def expanded(blocks: DataFrame) -> DataFrame:
    """blocks: side, ids_a, ids_b and more. The pairs of ids, the smaller one as a; side: -1 those smaller in ids_a only, 1 those smaller in ids_b only."""
    more = [c for c in blocks.columns if c not in ("side", "ids_a", "ids_b")]
    pairs = blocks.select("side", F.explode("ids_a").alias("p"), "ids_b", *more).select("side", "p", F.explode("ids_b").alias("q"), *more)
    return pairs.where("p < q AND side <= 0 OR p > q AND side >= 0").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *more)


def tfidf(corpus: DataFrame) -> DataFrame:
    """corpus: id, text. id, token, w: raw counts times ln((1 + N) / (1 + df)) + 1, L2-normalised."""
    words = corpus.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("token"))
    tf = words.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df")).cast("double")) + 1))  # one row
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, "id").select("id", "token", (F.col("x") / F.col("norm")).alias("w"))


def cosine_pairs(weights: DataFrame, pairs: DataFrame, tau: float = 0.6) -> DataFrame:
    """weights: id, token, w. pairs: a, b. score: cosine clipped to 0..1."""
    a = pairs.join(weights.select(F.col("id").alias("a"), "token", F.col("w").alias("wa")), "a")
    both = a.join(weights.select(F.col("id").alias("b"), "token", F.col("w").alias("wb")), ["b", "token"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    score = F.least(F.greatest(F.coalesce("dot", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return pairs.select("a", "b").join(dots, ["a", "b"], "left").select("a", "b", score.alias("score")).withColumn("mergeable", F.col("score") >= tau)


def similar_pairs(weights: DataFrame, least: float) -> DataFrame:
    """weights: id, token, w of unit length. a, b: all pairs whose cosine can reach ``least``, and few others.

    Tokens are ordered from the rarest on. Where what follows a token in a text
    is shorter than ``least``, that token and the later ones can't make up the
    cosine by themselves, so a pair that reaches it shares one before: texts
    meet in their rare tokens only.
    """
    df = weights.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    onward = Window.partitionBy("id").orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rare = weights.join(df, "token").withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward))).where(F.col("rest") >= least - 1e-9)
    other = rare.select(F.col("id").alias("b"), "token")
    return rare.select(F.col("id").alias("a"), "token").join(other, "token").where("a < b").select("a", "b").distinct()


def stand_ins(library: DataFrame, asked: DataFrame) -> DataFrame:
    """library: pos, id, text. asked: token. bag, t: the first row (order, id) of all that have the same of the asked tokens; rows without any are left out."""
    rows = library.select("pos", "id", F.explode(S.tokens(F.col("text"), 2)).alias("token")).join(asked.distinct(), "token", "left_semi")
    # Rows that share pos and id add up, so this is a bag of tokens and no set.
    bags = rows.groupBy("pos", "id").agg(F.sort_array(F.collect_list("token")).alias("bag"))
    return bags.groupBy("bag").agg(F.max(F.struct((-F.col("pos")).alias("order"), "id")).alias("t"))


def keyword_retrieval(queries: DataFrame, library: DataFrame) -> DataFrame:
    """queries: query_id, text. library: pos, id, text. The row with most tokens (of two characters and more) in common; the first of equals.

    Of a row only the tokens that some query has matter. Rows with the same of
    them have the same score for every query, so the first of these stands for
    all; the bags of tokens that are left meet queries by a join on tokens. A
    query without a token in common has no row.
    """
    q = queries.select("query_id", F.explode(S.tokens(F.col("text"), 2)).alias("token"))
    first = stand_ins(library, q.select("token"))
    hits = q.join(first.select("bag", "t", F.explode("bag").alias("token")), "token").groupBy("query_id", "bag").agg(F.count(F.lit(1)).alias("score"), F.first("t").alias("t"))
    top = hits.groupBy("query_id").agg(F.max(F.struct("score", "t.order", "t.id")).alias("t"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.col("t.id").alias("id"), F.coalesce("t.score", F.lit(0)).alias("score"))


def reply_verdicts(replies: DataFrame) -> DataFrame:
    """replies: a, b, reply. relation and mergeable of recorded replies."""
    r = S.reply_relation(F.col("reply"))
    return replies.select("a", "b", r.alias("relation"), r.isin("EXACT", "PERCEPTUAL").alias("mergeable"))


def review_labels(raw: DataFrame) -> DataFrame:
    """raw: annotator, a, b, label. Upper-case, without blank, unknown and UNCERTAIN labels; pair -> list in order of annotators."""
    ok = raw.withColumn("label", F.upper(F.trim("label"))).where(F.col("label").isin(*S.RELATIONS))
    rows = ok.select(*S.pair_key("a", "b"), "annotator", "label").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("x"))
    return rows.select("a", "b", F.transform("x", lambda x: x["label"]).alias("labels"))


def review_slice(truth: DataFrame, output: DataFrame, laden: tuple[str, ...] = ("SEMANTIC_PRESERVING", "COMPLEMENTARY")) -> DataFrame:
    """Pairs that people should look at: truths that take judgement, and verdicts that abstain."""
    rows = truth.join(output.select("a", "b", F.col("relation").alias("verdict")), ["a", "b"], "left")
    return rows.where(F.col("relation").isin(*laden) | (F.col("verdict") == "UNCERTAIN")).withColumn("label", F.lit("")).orderBy("a", "b")
