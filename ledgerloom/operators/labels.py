"""Labels of a survey from blind passes to a table: cells and draws, import, review, assembly, merging, resolution, examples."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import rank_digest
from ledgerloom.plans.joins import require_unique

#: Statuses under which a label counts as settled, and the label of what nobody could settle.
SETTLED, OPEN = ("model_agreed", "founder_confirmed", "founder_adjudicated"), "INSUFFICIENT_EVIDENCE"


def cell_populations(cases: DataFrame, *keys: str) -> DataFrame:
    """(keys, population): the cases of every cell of a design."""
    return cases.groupBy(*keys).agg(F.count("*").alias("population"))


def draw_cells(cases: DataFrame, key: str, cells: list[str], quota: DataFrame, purpose: str) -> DataFrame:
    """The cases drawn from each cell (the columns ``cells``) in the order of their digests, with their inclusion probability.

    ``quota`` is (cells, wanted), a cell once; cells without quota give nothing, small ones give all they have.  A
    cell's cases are cut in salted parts first, so no task orders a whole cell.
    """
    sized = cases.join(cell_populations(cases, *cells), cells).join(F.broadcast(quota), cells).withColumn("digest", rank_digest(purpose, F.col(key)))
    part = Window.partitionBy(*cells, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("digest", key)
    near = sized.withColumn("_r", F.row_number().over(part)).filter("_r <= wanted").drop("_r")
    drawn = near.withColumn("draw_rank", F.row_number().over(Window.partitionBy(*cells).orderBy("digest", key))).filter("draw_rank <= wanted")
    return drawn.withColumn("inclusion_probability", F.least(F.col("wanted"), F.col("population")) / F.col("population")).drop("digest")


def check_answers(queue: DataFrame, answers: DataFrame, labels: list[str], longest: int) -> DataFrame:
    """(queue_id, problem) of a labeller's rows against the queue: unknown, missing, repeated, bad label, no reason, long reason."""
    own = answers.groupBy("queue_id").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.min("reason").alias("reason"))
    both = queue.select("queue_id", F.lit(True).alias("asked")).distinct().join(own, "queue_id", "full")
    problem = (
        F.when(F.col("asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
        .when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "label").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason")
        .when(F.length("reason") > longest, "long_reason")
    )
    return both.select("queue_id", problem.alias("problem")).filter("problem is not null")


def import_pass(queue: DataFrame, answers: DataFrame, labeller: str, labels: list[str], longest: int = 500) -> DataFrame:
    """(case_id, label, reason, is_repeat, labeller_id): a pass with every queue id resolved to its case; a bad row is an error."""
    bad = check_answers(queue, answers, labels, longest).orderBy("queue_id").take(3)
    if bad:
        raise ValueError(f"labeller rows: {[tuple(r) for r in bad]}")
    key = require_unique(queue, "queue_id").select("queue_id", "case_id", "is_repeat")
    return answers.join(key, "queue_id").select("case_id", "label", "reason", "is_repeat", F.lit(labeller).alias("labeller_id"))


def _originals(labels: DataFrame, side: str) -> DataFrame:
    own = labels.filter("not is_repeat")
    return own.select("case_id", F.col("label").alias(f"label_{side}"), F.col("reason").alias(f"reason_{side}"))


def review_selection(first: DataFrame, second: DataFrame, cells: DataFrame, per_cell: int, purpose: str) -> DataFrame:
    """(case_id, review_type, split, stratum): every disagreement of two passes, and of each (split, stratum) some agreed cases by digest."""
    both = _originals(first, "a").join(_originals(second, "b"), "case_id").join(cells.select("case_id", "split", "stratum"), "case_id")
    both = both.withColumns({"agreed": F.col("label_a") == F.col("label_b"), "digest": rank_digest(purpose, F.col("case_id"))})
    place = F.row_number().over(Window.partitionBy("agreed", "split", "stratum").orderBy("digest", "case_id"))
    kept = both.withColumn("_r", place).filter(~F.col("agreed") | (F.col("_r") <= per_cell))
    return kept.select("case_id", F.when(F.col("agreed"), "audit").otherwise("disagreement").alias("review_type"), "split", "stratum")


def assemble(first: DataFrame, second: DataFrame, decisions: DataFrame, open_ones: str = "unresolved") -> DataFrame:
    """(case_id, label, reason, status, is_repeat): the labels of a round from two passes and the reviewer's decisions.

    | passes   | decision     | label and reason        | status              |
    |----------|--------------|-------------------------|---------------------|
    | agree    | none         | the first pass's        | model_agreed        |
    | agree    | confirmed    | the first pass's        | founder_confirmed   |
    | agree    | overturned   | the reviewer's          | founder_adjudicated |
    | disagree | adjudicated  | the reviewer's          | founder_adjudicated |
    | disagree | none         | OPEN, both answers told | blind_unresolved    |
    | any      | any          | each hidden repeat's    | blind_repeat        |

    ``decisions`` is (case_id, decision, label, note), a case once.  A decision that fits no line, or for a case
    outside the round, is an error; so is a disagreement without decision if ``open_ones`` is ``error``.
    """
    both = _originals(first, "a").join(_originals(second, "b"), "case_id", "full")
    told = require_unique(decisions, "case_id").select("case_id", "decision", F.col("label").alias("label_d"), F.col("note").alias("note_d"))
    rows = both.join(told, "case_id", "full")
    agree, none = F.col("label_a") == F.col("label_b"), F.col("decision").isNull()
    status = (
        F.when(agree & none, "model_agreed").when(agree & (F.col("decision") == "confirmed"), "founder_confirmed").when(agree & (F.col("decision") == "overturned"), "founder_adjudicated")
        .when(~agree & (F.col("decision") == "adjudicated"), "founder_adjudicated").when(~agree & none & F.lit(open_ones != "error"), "blind_unresolved")
    )
    rows = rows.withColumn("status", status)
    wrong = rows.filter("status is null").orderBy("case_id").take(3)
    if wrong:
        raise ValueError(f"labels cannot be assembled, e.g. {[(r['case_id'], r['label_a'], r['label_b'], r['decision']) for r in wrong]}")
    mine, unsettled = F.col("status") == "founder_adjudicated", F.col("status") == "blind_unresolved"
    both_answers = F.concat(F.lit("pass a: "), "label_a", F.lit("; pass b: "), "label_b")
    settled = rows.select(
        "case_id", F.when(mine, F.col("label_d")).when(unsettled, OPEN).otherwise(F.col("label_a")).alias("label"),
        F.when(mine, F.col("note_d")).when(unsettled, both_answers).otherwise(F.col("reason_a")).alias("reason"), "status", F.lit(False).alias("is_repeat"),
    )
    again = first.filter("is_repeat").unionByName(second.filter("is_repeat"))
    return settled.unionByName(again.select("case_id", "label", "reason", F.lit("blind_repeat").alias("status"), F.lit(True).alias("is_repeat")))


def merge_rounds(rounds: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """The labels of several rounds with ``round``; a case that two rounds label, repeats aside, is an error."""
    out = reduce(DataFrame.unionByName, [labels.withColumn("round", F.lit(name)) for name, labels in rounds])
    twice = out.filter("not is_repeat").groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").orderBy("case_id").take(1)
    if twice:
        raise ValueError(f"case labelled twice: {twice[0]['case_id']}")
    return out


def label_manifest(labels: DataFrame) -> DataFrame:
    """(round, status, label, n): what a label table holds."""
    return labels.groupBy("round", "status", "label").agg(F.count("*").alias("n"))


def resolve_labels(labels: DataFrame, positive: str, negative: str, settled_only: bool = False) -> DataFrame:
    """(case_id, label, y) of every case, repeats left out; y is 1, 0, or null where the label is neither.

    Cases whose labels contradict one another are an error.  ``settled_only`` leaves out what nobody settled,
    which a denominator must not.
    """
    own = labels.filter("not is_repeat")
    if settled_only:
        own = own.filter(F.col("status").isin(*SETTLED))
    per = own.groupBy("case_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    clash = per.filter("label <> _most").orderBy("case_id").take(1)
    if clash:
        raise ValueError(f"conflicting labels of case {clash[0]['case_id']}")
    return per.select("case_id", "label", F.when(F.col("label") == positive, 1.0).when(F.col("label") == negative, 0.0).alias("y"))


def answer_repeats(labels: DataFrame) -> DataFrame:
    """One row (repeats, same, share): how often a hidden repeat got the answer of its original, by labeller id."""
    first = labels.filter("not is_repeat").select("case_id", "labeller_id", F.col("label").alias("before"))
    both = labels.filter("is_repeat").join(first, ["case_id", "labeller_id"])
    out = both.agg(F.count("*").alias("repeats"), F.count_if(F.col("label") == F.col("before")).alias("same"))
    return out.withColumn("share", F.round(F.try_divide(F.col("same"), F.col("repeats")), 9))


def agreement_of_twins(pairs: DataFrame, fields: list[str], label: str) -> DataFrame:
    """One row (twins, agreed, share): labelled pairs that stand twice, told by their fields, and how many got one label.

    Fields that are null count as empty; what stands once, or more than twice, is no twin.
    """
    sign = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])), 256)
    per = pairs.groupBy(sign.alias("s")).agg(F.count("*").alias("n"), F.count(label).alias("k"), F.min(label).alias("lo"), F.max(label).alias("hi")).filter("n = 2 and k = 2")
    out = per.agg(F.count("*").alias("twins"), F.count_if(F.col("lo") == F.col("hi")).alias("agreed"))
    return out.withColumn("share", F.round(F.try_divide(F.col("agreed"), F.col("twins")), 9))


def independent_draw(pairs: DataFrame, left: str, right: str, wanted: int, purpose: str) -> DataFrame:
    """Up to ``wanted`` pairs such that no record stands in two, in the order of their digests.

    In each round every pair that comes first at both of its ends is taken and its neighbours fall out, which gives
    what taking one pair after another does.
    """
    live = pairs.select(left, right).distinct().withColumn("digest", rank_digest(purpose, F.concat_ws("|", left, right)))
    spark, taken = pairs.sparkSession, None
    from ledgerloom.plans.spool import Spool

    spool = Spool(spark, "independent")
    live = spool.save(live)
    while live.spool_rows:
        ends = live.select(F.explode(F.array(left, right)).alias("x"), "digest").groupBy("x").agg(F.min("digest").alias("least"))
        side = lambda c, s: ends.select(F.col("x").alias(c), F.col("least").alias(s))
        first = spool.save(live.join(side(left, "_l"), left).join(side(right, "_r"), right).filter("digest = _l and digest = _r").select(left, right, "digest"))
        used = first.select(F.explode(F.array(left, right)).alias("x")).distinct()
        rest = live.join(used.withColumnRenamed("x", left), left, "left_anti").join(used.withColumnRenamed("x", right), right, "left_anti")
        live = spool.save(rest.select(left, right, "digest"))
        taken = first if taken is None else taken.unionByName(first)
    out = (taken if taken is not None else live).orderBy("digest").limit(wanted)
    return out.select(left, right, F.row_number().over(Window.orderBy("digest")).alias("draw_rank"))


def unseen(pairs: DataFrame, earlier: DataFrame, fields: list[str]) -> DataFrame:
    """The pairs whose texts no earlier batch showed; null fields count as empty."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    seen = earlier.select(text.alias("_t")).distinct()
    return pairs.withColumn("_t", text).join(seen, "_t", "left_anti").drop("_t")


def curated_examples(cases: DataFrame, key: str, cell: str, wrong: str, caps: dict[str, int], most_wrong: int, least: int, most: int, purpose: str) -> DataFrame:
    """(key, cell, wrong, place): examples to show: of each cell up to its cap, of those at most ``most_wrong`` that a model got wrong,
    filled from all others up to ``least`` and cut at ``most``, everything by digest."""
    ranked = cases.select(key, cell, wrong, rank_digest(purpose, F.col(key)).alias("digest"))
    cap = F.coalesce(F.create_map(*[x for c, n in sorted(caps.items()) for x in (F.lit(c), F.lit(n))])[F.col(cell)], F.lit(0))
    part = Window.partitionBy(cell, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("digest", key)
    bound = max([most, *caps.values()])
    # No more than this many of a cell, right or wrong, can be chosen or fill up.
    near = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(cell, wrong, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("digest", key))).filter(F.col("_r") <= bound).drop("_r")
    errors = F.row_number().over(Window.partitionBy(wrong).orderBy("digest", key))
    fit = near.withColumn("_e", errors).withColumn("allowed", ~F.col(wrong) | (F.col("_e") <= most_wrong)).drop("_e")
    fit = fit.withColumn("_r", F.row_number().over(Window.partitionBy(cell, "allowed").orderBy("digest", key)))
    fit = fit.withColumn("chosen", F.col("allowed") & (F.col("_r") <= cap)).filter("allowed")
    order = Window.orderBy(F.desc("chosen"), "digest", key)
    placed = fit.withColumn("place", F.row_number().over(order)).withColumn("_c", F.count_if("chosen").over(Window.partitionBy()))
    return placed.filter((F.col("place") <= most) & (F.col("chosen") | (F.col("place") <= least))).select(key, cell, wrong, "place")


def maker_cells(cases: DataFrame, routes: list[str], words: str, share: float) -> DataFrame:
    """``cases`` (case_id, region, split, group_id, name, accepted, route, score) with ``cell``.

    Accepted cases are ``A1`` on a route of ``routes`` and ``A2`` else.  A rejected case is the first of ``B1``, its
    group stands on such a route somewhere; ``B2``, among the ``share`` of best scores of its region and split;
    ``B3``, its name matches ``words``; ``B4``.  Shares are rounded half to even; ties of a score by the case.
    """
    makers = cases.filter(F.col("route").isin(*routes)).select("group_id").distinct().withColumn("maker", F.lit(True))
    marked = cases.join(makers, "group_id", "left").withColumn("maker", F.coalesce("maker", F.lit(False)))
    pool = ~F.col("accepted") & ~F.col("maker")
    size = F.bround(share * F.count_if(pool).over(Window.partitionBy("region", "split")), 0)
    place = F.row_number().over(Window.partitionBy("region", "split", pool).orderBy(F.desc_nulls_last("score"), "case_id"))
    marked = marked.withColumns({"_size": size, "_place": place})
    cell = (
        F.when(F.col("accepted"), F.when(F.coalesce(F.col("route").isin(*routes), F.lit(False)), "A1").otherwise("A2")).when(F.col("maker"), "B1")
        .when(F.col("score").isNotNull() & (F.col("_place") <= F.col("_size")), "B2").when(F.upper(F.coalesce("name", F.lit(""))).rlike(words), "B3").otherwise("B4")
    )
    return marked.withColumn("cell", cell).drop("maker", "_size", "_place")


def cell_table(cells: DataFrame, splits: list[str]) -> DataFrame:
    """(region, cell, one column for each split, total)."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    return cells.groupBy("region", "cell").agg(*counts, F.count("*").alias("total"))
