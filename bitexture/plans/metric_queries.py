"""Queries over BLEU, losses and training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitexture.functions import scores as M
from bitexture.operators import bleu as B
from bitexture.operators import runs as R
from bitexture.plans import inputs as I
from bitexture.plans.registry import query
from bitexture.session import checkpointed
from bitexture.streaming.jobs import debounce as debounce_rows

q = I.with_inputs

# clipped matches and totals per row, spelled out with one row per n-gram
_SQL_COUNTS = """toks AS MATERIALIZED (SELECT id, list_filter(string_split(trim(hyp), ' '), lambda x: x <> '') AS h,
      list_filter(string_split(trim(ref), ' '), lambda x: x <> '') AS r FROM hypotheses),
  words AS MATERIALIZED (
    SELECT id, 1 AS hyp, unnest(h) AS w, generate_subscripts(h, 1) AS pos FROM toks
    UNION ALL SELECT id, 0, unnest(r), generate_subscripts(r, 1) FROM toks),
  next_words AS MATERIALIZED (SELECT id, hyp, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d
    FROM words WINDOW p AS (PARTITION BY id, hyp ORDER BY pos)),
  grams AS MATERIALIZED (
    SELECT id, hyp, 1 AS n, a AS gram FROM next_words
    UNION ALL SELECT id, hyp, 2, a || ' ' || b FROM next_words WHERE b IS NOT NULL
    UNION ALL SELECT id, hyp, 3, a || ' ' || b || ' ' || c FROM next_words WHERE c IS NOT NULL
    UNION ALL SELECT id, hyp, 4, a || ' ' || b || ' ' || c || ' ' || d FROM next_words WHERE d IS NOT NULL),
  matched AS (SELECT id, n, sum(least(ch, cr)) AS m FROM (
      SELECT id, n, gram, sum(hyp) AS ch, sum(1 - hyp) AS cr FROM grams GROUP BY 1, 2, 3) GROUP BY 1, 2),
  stats AS MATERIALIZED (SELECT t.id, len(h) AS hyp_len, len(r) AS ref_len,
      coalesce(max(m) FILTER (n = 1), 0) AS m1, coalesce(max(m) FILTER (n = 2), 0) AS m2,
      coalesce(max(m) FILTER (n = 3), 0) AS m3, coalesce(max(m) FILTER (n = 4), 0) AS m4,
      greatest(len(h), 0) AS t1, greatest(len(h) - 1, 0) AS t2, greatest(len(h) - 2, 0) AS t3, greatest(len(h) - 3, 0) AS t4
      FROM toks t LEFT JOIN matched USING (id) GROUP BY t.id, h, r)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in "hyp_len ref_len m1 m2 m3 m4 t1 t2 t3 t4".split())
_BP = "CASE WHEN hyp_len >= ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1 - ref_len / hyp_len) END"


def _log_sum():
    """Sum of log precisions with exponential smoothing of zero orders."""
    parts = []
    for n in range(1, 5):
        zeros = " + ".join(f"CASE WHEN t{k} > 0 AND m{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1))
        parts.append(
            f"CASE WHEN t{n} = 0 THEN 0 WHEN m{n} = 0 THEN ln(1.0 / (pow(2, {zeros}) * t{n})) ELSE ln(m{n} / t{n}) END"
        )
    return " + ".join(parts)


_ORDERS = " + ".join(f"CASE WHEN t{n} > 0 THEN 1 ELSE 0 END" for n in range(1, 5))
_SCORE = f"CASE WHEN m1 + m2 + m3 + m4 = 0 THEN 0.0 ELSE 100.0 * {_BP} * exp(({_log_sum()}) / ({_ORDERS})) END"


def _with_counts(body):
    return q("SELECT @", "hypotheses").replace("SELECT @", f", {_SQL_COUNTS} {body}")


SQL_CORPUS_BLEU = _with_counts(f"SELECT *, round({_SCORE}, 6) AS bleu FROM (SELECT {_SUMS} FROM stats)")


@query(SQL_CORPUS_BLEU)
def corpus_bleu(spark, sf):
    out = B.corpus_bleu(I.hypotheses(spark, sf), "none")
    return out.withColumn("bleu", F.round("bleu", 6))


_RULES_13A = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace(replace(replace(
   replace(replace(replace(@, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '),
   '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
   '([\{-\~\[-\x60 -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'),
   '([0-9])(-)', '\1 \2 ', 'g')"""


@query(
    _with_counts(f"SELECT *, round({_SCORE}, 6) AS bleu FROM (SELECT {_SUMS} FROM stats)").replace(
        "string_split(trim(hyp), ' ')", r"string_split_regex(" + _RULES_13A.replace("@", "hyp", 1) + r", '[\s\x{a0}]+')"
    ).replace(
        "string_split(trim(ref), ' ')", r"string_split_regex(" + _RULES_13A.replace("@", "ref", 1) + r", '[\s\x{a0}]+')"
    )
)
def corpus_bleu_13a(spark, sf):
    """With the mteval-v13a tokenizer."""
    out = B.corpus_bleu(I.hypotheses(spark, sf), "13a")
    return out.withColumn("bleu", F.round("bleu", 6))


@query(_with_counts(f"SELECT id, round({_SCORE}, 6) AS score FROM stats"))
def sentence_bleu(spark, sf):
    out = B.sentence_bleu(I.hypotheses(spark, sf), "none")
    return out.select("id", F.round("score", 6).alias("score"))


def _scored(spark, sf):
    return B.sentence_bleu(I.hypotheses(spark, sf), "none").withColumn("score", F.round("score", 6))


SQL_BEST_AND_WORST = _with_counts(
    f"""SELECT 'best' AS side, * FROM (SELECT id, round({_SCORE}, 6) AS score FROM stats ORDER BY 2 DESC, 1 LIMIT 5)
        UNION ALL SELECT 'worst', * FROM (SELECT id, round({_SCORE}, 6) AS score FROM stats ORDER BY 2, 1 LIMIT 5)"""
)


@query(SQL_BEST_AND_WORST)
def best_and_worst(spark, sf):
    # read twice, scored once
    scored = checkpointed(_scored(spark, sf).select("id", "score"))
    best, worst = B.best_sentences(scored), B.worst_sentences(scored)
    return best.select(F.lit("best").alias("side"), "*").unionByName(worst.select(F.lit("worst").alias("side"), "*"))


@query(_with_counts("SELECT id, gram, CAST(sum(hyp) AS BIGINT) AS n FROM grams WHERE n = 2 AND hyp = 1 GROUP BY 1, 2"))
def ngram_counts(spark, sf):
    rows = I.hypotheses(spark, sf).select("id", B.bleu_tokens(F.col("hyp"), "none").alias("tokens"))
    return B.ngram_counts(rows, 2)


@query(
    q(
        """SELECT batch_id, round(avg(CASE WHEN target <> 0 THEN -logprob END), 6) AS loss,
             count(*) FILTER (target <> 0) AS n_tokens FROM token_scores GROUP BY 1""",
        "token_scores",
    )
)
def masked_token_loss(spark, sf):
    out = R.masked_token_loss(I.token_scores(spark, sf), ["batch_id"])
    return out.withColumn("loss", F.round("loss", 6))


@query(
    q(
        """SELECT batch_id, round(avg(CASE WHEN target <> 0 THEN 0.9 * -logprob + 0.1 * -mean_logprob END), 6) AS loss,
             count(*) FILTER (target <> 0) AS n_tokens FROM token_scores GROUP BY 1""",
        "token_scores",
    )
)
def smoothed_token_loss(spark, sf):
    out = R.masked_token_loss(I.token_scores(spark, sf), ["batch_id"], smoothing=0.1)
    return out.withColumn("loss", F.round("loss", 6))


_BATCHES = """(SELECT batch_id, batch_id % 10 AS epoch, avg(CASE WHEN target <> 0 THEN -logprob END) AS loss,
    count(*) FILTER (target <> 0) AS n_tokens FROM token_scores GROUP BY 1)"""


@query(
    q(
        f"""SELECT a.epoch, round(avg(loss), 6) AS batch_mean, count(loss) AS n_batches,
              round(sum(loss * n_tokens) / sum(n_tokens), 6) AS token_mean FROM {_BATCHES} a GROUP BY 1""",
        "token_scores",
    )
)
def epoch_loss(spark, sf):
    batches = R.masked_token_loss(I.token_scores(spark, sf), ["batch_id"]).withColumn("epoch", F.col("batch_id") % 10)
    a = R.epoch_loss(batches, ["epoch"]).select("epoch", F.round("loss", 6).alias("batch_mean"), "n_batches")
    b = R.epoch_loss(batches, ["epoch"], "token").select("epoch", F.round("loss", 6).alias("token_mean"))
    return a.join(b, "epoch")


@query(q("SELECT run_id, arg_min(epoch, {'v': val, 'e': epoch}) FILTER (val IS NOT NULL) AS best_epoch, min(val) AS best_val FROM runs GROUP BY 1", "runs"))
def best_epoch(spark, sf):
    return R.best_epoch(I.runs(spark, sf))


@query(q("SELECT run_id, epoch, val, prev_best, coalesce(val < coalesce(prev_best, 'infinity'::DOUBLE), false) AS improved FROM judged_runs", "judged_runs"))
def best_so_far(spark, sf):
    return R.best_so_far(I.runs(spark, sf)).select("run_id", "epoch", "val", "prev_best", "improved")


_STOP = """steps AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS step,
      coalesce(val < coalesce(prev_best, 'infinity'::DOUBLE), false) AS improved FROM judged_runs),
  waits AS (SELECT *, step - coalesce(max(CASE WHEN improved THEN step END) OVER (PARTITION BY run_id ORDER BY epoch), 0) AS no_improve
      FROM steps),
  ends AS (SELECT run_id, min(step) AS stop_step FROM waits WHERE no_improve >= 3 GROUP BY 1)"""


@query(
    q("SELECT @", "judged_runs").replace(
        "SELECT @",
        f""", {_STOP} SELECT run_id, epoch, val, no_improve, coalesce(step = stop_step, false) AS stopped
            FROM waits LEFT JOIN ends USING (run_id) WHERE stop_step IS NULL OR step <= stop_step""",
    )
)
def early_stop(spark, sf):
    return R.early_stop(I.runs(spark, sf), patience=3).select("run_id", "epoch", "val", "no_improve", "stopped")


@query(
    q(
        """SELECT run_id, epoch, round(exp(val / 100), 6) AS perplexity,
             CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY val, epoch) = 1 THEN '*' ELSE '' END AS mark FROM runs""",
        "runs",
    )
)
def mark_best(spark, sf):
    """The epoch table with its perplexity (losses scaled down to fit)."""
    out = R.mark_best(I.runs(spark, sf))
    return out.select("run_id", "epoch", F.round(M.perplexity(F.col("val") / 100), 6).alias("perplexity"), "mark")


@query(
    q(
        """SELECT run_id, n, batches, CAST(total AS DOUBLE) / batches AS running_mean FROM (
             SELECT run_id, n, row_number() OVER w AS batches, sum(loss) OVER w AS total FROM batch_losses
             WINDOW w AS (PARTITION BY run_id ORDER BY n)) WHERE batches % 500 = 0""",
        "batch_losses",
    )
)
def running_loss(spark, sf):
    return R.running_loss(I.batch_losses(spark, sf))


@query(
    q("SELECT run_id, epoch, CAST(sum(n_batches) OVER (PARTITION BY run_id ORDER BY epoch) AS BIGINT) AS step_num FROM runs", "runs")
)
def running_step(spark, sf):
    return R.running_step(I.runs(spark, sf)).select("run_id", "epoch", "step_num")


@query(
    q(
        """SELECT name, pos, round(avg(v), 6) AS value FROM (
             SELECT name, CAST(v AS DOUBLE) AS v, pos - 1 AS pos FROM (
               SELECT name, unnest(values_) AS v, generate_subscripts(values_, 1) AS pos FROM parameters)) GROUP BY 1, 2""",
        "parameters",
    )
)
def average_vectors(spark, sf):
    out = R.average_vectors(I.parameters(spark, sf))
    return out.select("name", F.posexplode("values").alias("pos", "value")).select(
        "name", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query(q("SELECT ckpt, CAST(sum(len(values_)) AS BIGINT) AS n_params FROM parameters GROUP BY 1", "parameters"))
def param_count(spark, sf):
    return R.param_count(I.parameters(spark, sf), ["ckpt"])


@query(
    q(
        """SELECT 'name' AS by, name, epoch FROM (SELECT DISTINCT 'transformer_ep' || ckpt || '.pt' AS name, ckpt AS epoch FROM parameters
             ORDER BY name DESC LIMIT 3)
           UNION ALL
           SELECT 'epoch', name, epoch FROM (SELECT DISTINCT 'transformer_ep' || ckpt || '.pt' AS name, ckpt AS epoch FROM parameters
             ORDER BY epoch DESC LIMIT 3)""",
        "parameters",
    )
)
def last_k_artifacts(spark, sf):
    files = I.parameters(spark, sf).select(
        F.concat(F.lit("transformer_ep"), F.col("ckpt").cast("string"), F.lit(".pt")).alias("name"), F.col("ckpt").alias("epoch")
    ).distinct()
    by_name = R.last_k_artifacts(files, 3, "name").select(F.lit("name").alias("by"), "name", "epoch")
    by_epoch = R.last_k_artifacts(files, 3, "epoch").select(F.lit("epoch").alias("by"), "name", "epoch")
    return by_name.unionByName(by_epoch)


_METRICS = """metrics AS (SELECT run_id AS model, unnest(['loss', 'perplexity', 'bleu']) AS metric,
    unnest([round(min(val), 6), round(exp(min(val) / 10), 6), CASE WHEN run_id <> 'click' THEN round(max(train), 6) END]) AS value
    FROM runs WHERE run_id IN ('click', 'view') GROUP BY run_id),
  wide AS (SELECT metric, max(value) FILTER (model = 'click') AS a, max(value) FILTER (model = 'view') AS b FROM metrics GROUP BY 1)"""


@query(
    q("SELECT @", "runs").replace(
        "SELECT @",
        f""", {_METRICS} SELECT metric, a AS value_first, b AS value_second, round(a - b, 6) AS delta,
            CASE WHEN (metric = 'bleu' AND (a IS NULL OR b > a)) OR (metric <> 'bleu' AND b < a) THEN 'view' ELSE 'click' END AS winner
            FROM wide""",
    )
)
def compare_models(spark, sf):
    """Two runs as models; the first one has no BLEU."""
    runs = I.runs(spark, sf).where(F.col("run_id").isin("click", "view"))
    best = runs.groupBy(F.col("run_id").alias("model")).agg(F.min("val").alias("v"), F.max("train").alias("t"))
    bleu = F.when(F.col("model") != "click", F.round("t", 6))
    metrics = best.select(
        "model",
        F.inline(
            F.array(
                F.struct(F.lit("loss").alias("metric"), F.round("v", 6).alias("value")),
                F.struct(F.lit("perplexity").alias("metric"), F.round(M.perplexity(F.col("v") / 10), 6).alias("value")),
                F.struct(F.lit("bleu").alias("metric"), bleu.alias("value")),
            )
        ),
    )
    return R.compare_models(metrics, "click", "view").withColumn("delta", F.round("delta", 6))


@query(
    """SELECT o_orderkey AS step, round(greatest(pow(256, -0.5) * least(pow(s, -0.5), s * pow(3985, -1.5)), 1e-4), 9) AS lr
       FROM (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS s FROM orders WHERE o_orderkey > 0)"""
)
def noam_lr(spark, sf):
    """Learning rate at every step number found among the order keys."""
    steps = I.table(spark, sf, "orders").where(F.col("o_orderkey") > 0).select(F.col("o_orderkey").alias("step"))
    return steps.select("step", F.round(M.noam_lr(F.col("step"), 256, 3985), 9).alias("lr"))


@query(
    """SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 1800000000 AS fires_us, count(*) AS n_inputs,
         arg_max(event_id, epoch_us(ts)) AS text FROM (
         SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
           SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 1e18) > 1800000000
                     THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, burst"""
)
def debounce(spark, sf):
    """Bursts of events of a user, ended by a pause of 30 minutes."""
    events = I.table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("text"))
    out = debounce_rows(events, gap_us=1_800_000_000)
    return out.select(
        "user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("fires_at").alias("fires_us"), "n_inputs", "text"
    )
