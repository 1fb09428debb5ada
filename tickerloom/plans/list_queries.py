"""Queries on universes, scans, ranks and charts, with their SQL. A supplier is a symbol; a fixed hash of its key stands
in for its score, the order of account balances for the ranking that people made."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import cache as C
from tickerloom.operators import charts as H
from tickerloom.operators import lists as L
from tickerloom.operators import panel as P
from tickerloom.operators import patterns as N
from tickerloom.operators import places as W
from tickerloom.operators import ranking as R
from tickerloom.operators import score as S
from tickerloom.operators.sorting import Session
from tickerloom.plans import inputs as I
from tickerloom.sources import documents as D
from tickerloom.sources.keyed import BarCache, NameCache

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, *dates: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = I.with_dates(sql, *dates) if dates else sql
        return f

    return add


def _scores(spark, sf_dir):
    """symbol, true_rank, score, fms."""
    s = I.table(spark, sf_dir, "supplier")
    score = (F.pmod(F.col("s_suppkey") * 7919, F.lit(101)) / 10).alias("score")
    ranked = s.select(F.col("s_suppkey").cast("string").alias("symbol"), "s_suppkey", "s_acctbal", score)
    ranked = W.placed(ranked, [F.desc("s_acctbal"), F.col("s_suppkey")], "true_rank")
    return ranked.select("symbol", "true_rank", "score", F.when(F.col("s_suppkey") % 13 == 0, -999.0).otherwise(F.col("score")).alias("fms"))


SCORES = """scores AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS true_rank,
  (s_suppkey * 7919 % 101)::DOUBLE / 10 AS score, CASE WHEN s_suppkey % 13 = 0 THEN -999::DOUBLE ELSE (s_suppkey * 7919 % 101)::DOUBLE / 10 END AS fms FROM supplier)"""
RANKED = f"{SCORES}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, true_rank) AS model_rank FROM scores)"
WATCH = "watch AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal > 0)"


def _watch(spark, sf_dir):
    return I.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"))


@query(f"WITH {SCORES}, f AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rank_first, rank() OVER (ORDER BY score DESC) AS rank_min FROM scores) SELECT symbol, rank_first, rank_min, avg(rank_first) OVER (PARTITION BY score) AS rank_average FROM f")
def rank_methods(spark, sf_dir):
    return R.rank_methods(_scores(spark, sf_dir)).select("symbol", "rank_first", "rank_min", "rank_average")


_METRICS = "round(avg((a.score < b.score)::INTEGER), 6) AS inversion, round(avg(abs((b.true_rank - a.true_rank) - (b.model_rank - a.model_rank))), 6) AS pair_error"


@query(f"WITH {RANKED} SELECT {_METRICS}, (SELECT round(corr(true_rank, model_rank), 6) FROM ranked) AS rho FROM ranked a JOIN ranked b ON a.true_rank < b.true_rank")
def rank_metrics(spark, sf_dir):
    return I.rounded(R.rank_metrics(_scores(spark, sf_dir)))


@query(f"WITH {RANKED} SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, b.true_rank - a.true_rank + a.model_rank - b.model_rank AS gap FROM ranked a JOIN ranked b ON a.true_rank < b.true_rank AND a.score < b.score ORDER BY gap DESC, 1, 2 LIMIT 30")
def disagreeing_pairs(spark, sf_dir):
    return R.disagreements(_scores(spark, sf_dir))


@query(f"WITH {RANKED} SELECT symbol, true_rank, model_rank, abs(true_rank - model_rank) AS gap FROM ranked ORDER BY gap DESC, symbol LIMIT 25")
def residual_ranks(spark, sf_dir):
    return R.residuals(_scores(spark, sf_dir))


@query(f"WITH {RANKED}, k AS (SELECT count(*) AS n, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS k FROM ranked) SELECT n, k, round(count(*) FILTER (true_rank <= k AND model_rank <= k) / k, 6) AS recall FROM ranked, k GROUP BY n, k")
def top_quintile_recall(spark, sf_dir):
    return I.rounded(R.top_recall(_scores(spark, sf_dir)))


@query(f"WITH {SCORES} SELECT symbol, true_rank, ntile(5) OVER (ORDER BY true_rank) AS fold FROM scores")
def rank_folds(spark, sf_dir):
    return R.folds(_scores(spark, sf_dir), 5).select("symbol", "true_rank", "fold")


@query(f"WITH {SCORES} SELECT symbol, row_number() OVER (ORDER BY true_rank) AS true_rank FROM scores WHERE fms <> -999")
def resequenced_ranking(spark, sf_dir):
    return R.resequenced(_scores(spark, sf_dir).select("symbol", "true_rank", "fms"), F.col("fms") != -999).select("symbol", "true_rank")


_SWEEP = f"""{SCORES}, params AS (SELECT p AS param_id, p / 4::DOUBLE AS w FROM range(9) t(p)),
s AS (SELECT param_id, symbol, true_rank, score + w * (true_rank * 37 % 11) AS score FROM scores, params),
r AS (SELECT *, row_number() OVER (PARTITION BY param_id ORDER BY score DESC, true_rank) AS model_rank FROM s),
m AS (SELECT a.param_id, avg((a.score < b.score)::INTEGER) AS inversion, avg(abs((b.true_rank - a.true_rank) - (b.model_rank - a.model_rank))) AS pair_error FROM r a JOIN r b ON a.param_id = b.param_id AND a.true_rank < b.true_rank GROUP BY 1),
c AS (SELECT param_id, corr(true_rank, model_rank) AS rho FROM r GROUP BY 1), metrics AS (SELECT * FROM m JOIN c USING (param_id))"""


def _sweep(spark, sf_dir):
    params = spark.range(9).select(F.col("id").alias("param_id"), (F.col("id") / 4).alias("w"))
    each = _scores(spark, sf_dir).crossJoin(F.broadcast(params))  # nine parameter sets
    return R.rank_metrics(each.select("param_id", "symbol", "true_rank", (F.col("score") + F.col("w") * (F.col("true_rank") * 37 % 11)).alias("score")), ("param_id",))


@query(f"WITH {_SWEEP} SELECT param_id, round(inversion, 6) AS inversion, round(pair_error, 6) AS pair_error, round(rho, 6) AS rho FROM metrics")
def parameter_sweep(spark, sf_dir):
    return I.rounded(_sweep(spark, sf_dir))


@query(f"WITH {_SWEEP} SELECT param_id FROM metrics ORDER BY round(inversion, 9), round(-rho, 9), round(pair_error, 9), param_id LIMIT 1")
def best_parameters(spark, sf_dir):
    m = _sweep(spark, sf_dir)
    return R.best(m.select("param_id", *[F.round(c, 9).alias(c) for c in ("inversion", "rho", "pair_error")]), "param_id")


@query(f"WITH {_SWEEP}, b AS (SELECT * FROM metrics ORDER BY round(inversion, 9) DESC, round(-rho, 9) DESC, param_id LIMIT 1) SELECT m.param_id, round(m.inversion, 6) AS inversion FROM metrics m, b WHERE m.inversion < b.inversion AND m.rho > b.rho AND m.pair_error < b.pair_error")
def dominating_parameters(spark, sf_dir):
    m = _sweep(spark, sf_dir)
    worst = m.orderBy(F.desc(F.round("inversion", 9)), F.desc(F.round(-F.col("rho"), 9)), "param_id").limit(1)
    return I.rounded(R.dominating(m, worst).select("param_id", "inversion"))


@query(f"WITH {SCORES}, t AS (SELECT *, ntile(3) OVER (ORDER BY true_rank) AS k FROM scores) SELECT CASE k WHEN 1 THEN 'TOP' WHEN 2 THEN 'MID' ELSE 'BOT' END AS bucket, round(avg(score), 6) AS score FROM t GROUP BY k")
def group_means(spark, sf_dir):
    return I.rounded(R.thirds(_scores(spark, sf_dir), ["score"]))


@query(f"WITH {SCORES} SELECT count(score) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90, min(score) AS min, max(score) AS max FROM scores")
def score_summary(spark, sf_dir):
    return I.rounded(R.summary(_scores(spark, sf_dir), "score"))


@query(f"WITH {SCORES}, a AS (SELECT symbol, score AS x FROM scores WHERE true_rank % 7 <> 0), b AS (SELECT symbol, score + true_rank % 3 / 20::DOUBLE AS y FROM scores WHERE true_rank % 5 <> 0) SELECT count(abs(x - y)) AS n, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, round(max(abs(x - y)), 6) AS max_diff, round(quantile_cont(abs(x - y), 0.5), 6) AS median_diff, round(avg(abs(x - y)), 6) AS mean_diff, (SELECT round(corr(rx, ry), 6) FROM (SELECT rank() OVER (ORDER BY x DESC) AS rx, rank() OVER (ORDER BY round(y, 9) DESC) AS ry FROM a JOIN b USING (symbol))) AS rho, count(*) FILTER (round(abs(x - y), 9) >= 0.1) AS n_large FROM a FULL JOIN b USING (symbol)")
def compare_paths(spark, sf_dir):
    s = _scores(spark, sf_dir)
    a = s.where("true_rank % 7 <> 0").select("symbol", F.col("score").alias("fms"))
    b = s.where("true_rank % 5 <> 0").select("symbol", F.round(F.col("score") + F.col("true_rank") % 3 / 20, 9).alias("fms"))
    return I.rounded(R.compare_paths(a, b))


@query(f"WITH {SCORES} SELECT symbol, score, round((score - avg(score) FILTER (fms <> -999) OVER ()) / stddev_pop(score) FILTER (fms <> -999) OVER (), 6) AS z_score FROM scores")
def peer_z_scores(spark, sf_dir):
    return I.rounded(S.z_scores(_scores(spark, sf_dir), ["score"], F.col("fms") == -999).select("symbol", "score", "z_score"))


_SCREENER = """screener AS (SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_name AS company, '$' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(p_size * 10000 AS VARCHAR) || '' AS avg_volume,
  CAST(p_size - 20 AS VARCHAR) || '%' AS perf_quarter, CAST(CAST(p_retailprice * 0.9 AS DECIMAL(18,2)) AS VARCHAR) AS sma50 FROM part)"""


def _screener(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    text = lambda c: c.cast("decimal(18,2)").cast("string")
    return p.select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_name").alias("company"), F.concat(F.lit("$"), text(F.col("p_retailprice"))).alias("price"), (F.col("p_size") * 10000).cast("string").alias("avg_volume"), F.concat((F.col("p_size") - 20).cast("string"), F.lit("%")).alias("perf_quarter"), text(F.col("p_retailprice") * 0.9).alias("sma50"))


@query(f"WITH {_SCREENER} SELECT ticker, company FROM screener WHERE CAST(replace(price, '$', '') AS DOUBLE) >= 10 AND CAST(avg_volume AS DOUBLE) >= 300000 AND CAST(replace(perf_quarter, '%', '') AS DOUBLE) > 0 AND CAST(replace(price, '$', '') AS DOUBLE) >= CAST(sma50 AS DOUBLE)")
def screener_filters(spark, sf_dir):
    return L.screened(_screener(spark, sf_dir)).select("ticker", "company")


#: Every third part's number and name get a fund's ticker, word or number.
_FUND = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'TQQQ' WHEN 1 THEN 'llyx' WHEN 2 THEN 'A2X' ELSE 'Q' || p_partkey END AS t,
  p_name || CASE p_size % 12 WHEN 0 THEN ' 3x' WHEN 1 THEN ' Leveraged' WHEN 2 THEN ' inverse' WHEN 3 THEN ' Ultra' WHEN 4 THEN ' bear' WHEN 5 THEN ' Bull' WHEN 6 THEN ' short' WHEN 7 THEN ' ProShare' ELSE '' END AS n FROM part"""


@query(f"""SELECT p_partkey, upper(t) IN ('LLYX', 'SMST', 'GGLL', 'GOOX', 'TQQQ', 'SQQQ', 'SOXL', 'SOXS', 'UPRO', 'SPXU', 'UDOW', 'SDOW') OR regexp_matches(upper(t), '[0-9]+X') OR regexp_matches(upper(n), '[0-9]+X')
  OR regexp_matches(upper(t), 'LEVERAGE|LEVERAGED|LEV|INVERSE|INV|SHORT|BEAR|ULTRA|PRO|BULL') OR regexp_matches(upper(n), 'LEVERAGE|LEVERAGED|LEV|INVERSE|INV|SHORT|BEAR|ULTRA|PRO|BULL') AS leveraged FROM ({_FUND})""")
def leveraged_funds(spark, sf_dir):
    p, k, z = I.table(spark, sf_dir, "part"), F.col("p_partkey") % 9, F.col("p_size") % 12
    ticker = F.when(k == 0, "TQQQ").when(k == 1, "llyx").when(k == 2, "A2X").otherwise(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")))
    more = F.lit("")
    for n, word in enumerate((" 3x", " Leveraged", " inverse", " Ultra", " bear", " Bull", " short", " ProShare")):
        more = F.when(z == n, word).otherwise(more)
    return p.select("p_partkey", L.leveraged(ticker, F.concat("p_name", more)).alias("leveraged"))


_TICKER = "s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.KS' WHEN 1 THEN '.KQ' WHEN 2 THEN '.HK' WHEN 3 THEN '.T' ELSE '' END"


@query(f"SELECT CASE WHEN t LIKE '%.KS' OR t LIKE '%.KQ' THEN 'KOR' WHEN t LIKE '%.HK' THEN 'HKG' WHEN t LIKE '%.T' THEN 'JPN' ELSE 'USA' END AS market, count(*) AS n, max(printf('%04d.HK', s_suppkey)) AS code, max(regexp_replace(t, '[^A-Za-z0-9_.-]+', '_', 'g')) AS safe FROM (SELECT s_suppkey, {_TICKER} AS t FROM supplier) GROUP BY 1")
def market_counts(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    t = F.concat(F.col("s_suppkey").cast("string"), F.when(k == 0, ".KS").when(k == 1, ".KQ").when(k == 2, ".HK").when(k == 3, ".T").otherwise(""))
    s = I.table(spark, sf_dir, "supplier").select("s_suppkey", t.alias("t"))
    return s.groupBy(L.market_of(F.col("t")).alias("market")).agg(F.count("*").alias("n"), F.max(L.exchange_code(F.col("s_suppkey"))).alias("code"), F.max(L.safe_name(F.col("t"))).alias("safe"))


@query("SELECT page_id, total, CAST(ceil(total / 20::DOUBLE) AS BIGINT) AS pages FROM (SELECT page_id, CAST(replace(coalesce(nullif(regexp_extract(html, '/\\s*([0-9,]+)\\s*Total', 1), ''), nullif(regexp_extract(html, '(?i)\\bof\\s+([0-9,]+)', 1), '')), ',', '') AS BIGINT) AS total FROM (SELECT page_id, '#1 / ' || page_id * 37 || ' Total ' || html AS html FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'page 1 of ' || page_id * 3 || '. ' || html FROM pages WHERE page_id % 2 = 1))")
def screener_pages(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages")
    even = F.col("page_id") % 2 == 0
    html = F.when(even, F.concat(F.lit("#1 / "), F.col("page_id") * 37, F.lit(" Total "), "html")).otherwise(F.concat(F.lit("page 1 of "), F.col("page_id") * 3, F.lit(". "), "html"))
    found = p.select("page_id", L.page_total(html).alias("total"))
    return found.select("page_id", "total", L.effective_pages(F.lit(None).cast("long"), F.col("total")).alias("pages"))


@query(f"WITH {WATCH}, more AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_suppkey % 3 = 0), gone AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_suppkey % 4 = 0) SELECT symbol FROM (SELECT symbol FROM watch UNION SELECT symbol FROM more) WHERE symbol NOT IN (SELECT symbol FROM gone)")
def watchlist_changes(spark, sf_dir):
    every = I.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("symbol"))
    return L.removed(L.added(_watch(spark, sf_dir), every.where("s_suppkey % 3 = 0")), every.where("s_suppkey % 4 = 0"))


@query(f"WITH {SCORES}, {WATCH} SELECT symbol, fms FROM scores WHERE fms >= 2 AND symbol NOT IN (SELECT symbol FROM watch)")
def scan_candidates(spark, sf_dir):
    return L.candidates(_scores(spark, sf_dir), _watch(spark, sf_dir), 2.0).select("symbol", "fms")


@query(f"WITH {SCORES} SELECT symbol, fms FROM scores ORDER BY fms DESC, symbol LIMIT 5 OFFSET 5")
def second_page(spark, sf_dir):
    return L.page(_scores(spark, sf_dir).select("symbol", "fms").orderBy(F.desc("fms"), "symbol"), 2, 5)


@query(f"WITH {SCORES} SELECT symbol, fms FROM scores WHERE fms <> -999 AND fms < (SELECT quantile_cont(fms, 0.25) FROM scores WHERE fms <> -999)")
def bottom_quartile(spark, sf_dir):
    return L.reassess(_scores(spark, sf_dir)).select("symbol", "fms")


@query("WITH a AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, 0 AS source, s_suppkey AS ord FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, 'other' AS name, 1 AS source, -s_suppkey AS ord FROM supplier), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY source, ord) AS k FROM u) SELECT symbol, name, row_number() OVER (ORDER BY source, ord, symbol) AS ord FROM f WHERE k = 1")
def universe_union(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return L.first_wins(s.where("ord % 2 = 0"), s.select("symbol", F.lit("other").alias("name"), (-F.col("ord")).alias("ord")))


_BARS = f"{I.PRICES}, {I.aligned()}, b AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM aligned WHERE close > 0)"
_CHART = f"""{_BARS}, chart AS (SELECT symbol, date, close / first_value(close) OVER w * 100 AS rebased, close / max(close) OVER w - 1 AS drawdown, CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 END AS sma5
  FROM b WHERE rn <= 63 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))"""


def _panel(spark, sf_dir):
    return P.align(P.clean(I.prices(spark, sf_dir)))


@query(f"WITH {_CHART} SELECT symbol, date, round(rebased, 6) AS rebased, round(drawdown, 6) + 0.0 AS drawdown, round(sma5, 6) AS sma5 FROM chart", "date")
def rebased_chart(spark, sf_dir):
    return I.rounded(H.rebased(_panel(spark, sf_dir), "3M"))


@query(f"WITH {_CHART} SELECT round(log10(min(rebased)), 6) AS log_lo, round(log10(max(rebased)), 6) AS log_hi, round(min(drawdown) - (max(drawdown) - min(drawdown)) * 0.05::DOUBLE, 6) AS dd_lo, round(max(drawdown) + (max(drawdown) - min(drawdown)) * 0.05::DOUBLE, 6) AS dd_hi FROM chart")
def chart_ranges(spark, sf_dir):
    return I.rounded(H.axis_ranges(H.rebased(_panel(spark, sf_dir), "3M")))


@query(f"""WITH {_BARS}, r AS (SELECT symbol, date, close, rn, close / lag(close) OVER w - 1 AS r, lag(close, 63) OVER w AS base FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT *, CASE WHEN count(r) OVER f >= 21 THEN stddev_samp(r) OVER f * sqrt(252) END AS vol FROM r WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING))
SELECT symbol, date, rn, round(vol, 6) AS vol, CASE WHEN base IS NOT NULL THEN round(greatest((pow(close / base, 4) - 1) * 100 + 100, 0.1), 4) END AS y FROM v WHERE rn <= 3""", "date")
def return_vol_scatter(spark, sf_dir):
    return I.rounded(H.scatter(_panel(spark, sf_dir), 63, 3).withColumn("y", F.round("y", 4)))


_POINTS = f"""{_BARS}, r AS (SELECT symbol, date, close, rn, close / lag(close) OVER w - 1 AS r, lag(close, 63) OVER w AS base FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT *, CASE WHEN count(r) OVER f >= 21 THEN stddev_samp(r) OVER f * sqrt(252) END AS vol FROM r WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)),
points AS (SELECT symbol, date, rn, vol * 100 AS x, CASE WHEN base IS NOT NULL THEN greatest((pow(close / base, 4) - 1) * 100 + 100, 0.1) END AS y FROM v)"""


@query(f"""WITH {_POINTS} SELECT f.symbol, f.date, row_number() OVER (PARTITION BY f.symbol, f.date ORDER BY t.date) - 1 AS pos, round(t.x, 4) AS x, round(t.y, 4) AS y
FROM points f JOIN points t ON f.symbol = t.symbol AND t.rn BETWEEN f.rn AND f.rn + 5 WHERE f.rn <= 11 AND t.x IS NOT NULL AND t.y IS NOT NULL""", "date")
def motion_paths(spark, sf_dir):
    """Eleven frames of each symbol, each with a tail of five rows."""
    found = H.motion(_panel(spark, sf_dir)).select("symbol", "date", F.posexplode("tail").alias("pos", "p"))
    return I.rounded(found.select("symbol", "date", F.col("pos").cast("long").alias("pos"), F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y")))


@query(f"""WITH {_POINTS}, s AS (SELECT symbol, rn - 1 AS k, lag(x) OVER w AS from_x, lag(y) OVER w AS from_y, x, y FROM points WHERE rn <= 6 WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, k, round(from_x, 4) AS from_x, round(from_y, 4) AS from_y, round(x, 4) AS x, round(y, 4) AS y, round(greatest(0.15::DOUBLE, least(0.5::DOUBLE, (5 - k + 1) / 6::DOUBLE)), 6) AS opacity
FROM s WHERE from_x IS NOT NULL AND from_y IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL""")
def motion_tails(spark, sf_dir):
    found = H.tail_segments(_panel(spark, sf_dir))
    return I.rounded(found.withColumns({c: F.round(c, 4) for c in ("from_x", "from_y", "x", "y")}))


_CACHE = """cached AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE s_suppkey % 3 WHEN 0 THEN '1y' WHEN 1 THEN '2y' ELSE '6mo' END AS period, (s_suppkey * 31 % 600) AS n_bars, DATE '2024-01-10' AS last_date FROM supplier WHERE s_suppkey % 5 <> 0),
probe AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, DATE '2024-01-09' + CAST(s_suppkey % 4 AS INTEGER) AS probe_date FROM supplier WHERE s_suppkey % 7 <> 0)"""


@query(f"""WITH {_CACHE}, j AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, period, n_bars, last_date, probe_date FROM supplier LEFT JOIN cached ON cached.symbol = CAST(s_suppkey AS VARCHAR) LEFT JOIN probe ON probe.symbol = CAST(s_suppkey AS VARCHAR))
SELECT symbol, CASE WHEN last_date IS NULL THEN 'cold' WHEN NOT (period IN ('1y', '2y') AND n_bars >= 180) THEN 'period_miss' WHEN probe_date IS NULL THEN 'stale_hit' WHEN probe_date > last_date THEN 'miss' ELSE 'hit' END AS outcome FROM j""")
def cache_outcomes(spark, sf_dir):
    return C.classify(*_cache(spark, sf_dir), "1y")


def _cache(spark, sf_dir):
    k = F.col("s_suppkey")
    s = I.table(spark, sf_dir, "supplier").select("s_suppkey", k.cast("string").alias("symbol"))
    day = F.lit("2024-01-10").cast("date")
    cached = s.where("s_suppkey % 5 <> 0").select("symbol", F.when(k % 3 == 0, "1y").when(k % 3 == 1, "2y").otherwise("6mo").alias("period"), (k * 31 % 600).alias("n_bars"), day.alias("last_date"))
    probe = s.where("s_suppkey % 7 <> 0").select("symbol", F.date_add(F.date_sub(day, 1), (k % 4).cast("int")).alias("probe_date"))
    return s, cached, probe


_PART = lambda k: f"CAST(sum(('0x' || substr(h, {1 + 12 * k}, 12))::BIGINT) AS VARCHAR)"


@query(f"""WITH {I.OHLC}, e AS (SELECT symbol, max(date) FILTER (close IS NOT NULL) AS d, count(close) AS n, sha256(symbol || '|' || CAST(max(date) FILTER (close IS NOT NULL) AS VARCHAR) || '|' || count(close)) AS h FROM prices GROUP BY 1),
o AS (SELECT symbol, count(*) AS n FROM ohlc GROUP BY 1)
SELECT count(*) AS symbols, max(d) AS last_date, sum(n)::BIGINT AS n_bars, {" || '-' || ".join(map(_PART, range(5)))} AS digest, (SELECT count(*) FROM o) AS ohlc_symbols, (SELECT sum(n)::BIGINT FROM o) AS ohlc_n_bars FROM e""", "last_date")
def panel_fingerprint(spark, sf_dir):
    found = C.fingerprint(I.prices(spark, sf_dir), I.ohlc(spark, sf_dir))
    return I.rounded(found.select("symbols", "last_date", "n_bars", "digest", "ohlc_symbols", "ohlc_n_bars"))


@query(f"""WITH {_CACHE}, j AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, period, n_bars, last_date, probe_date FROM supplier LEFT JOIN cached ON cached.symbol = CAST(s_suppkey AS VARCHAR) LEFT JOIN probe ON probe.symbol = CAST(s_suppkey AS VARCHAR)),
o AS (SELECT CASE WHEN last_date IS NULL THEN 'cold' WHEN NOT (period = '2y' AND n_bars >= 360) THEN 'period' WHEN probe_date IS NULL THEN 'stale' WHEN probe_date > last_date THEN 'miss' ELSE 'hit' END AS o FROM j)
SELECT count(*) FILTER (o = 'hit') AS hits, count(*) FILTER (o = 'stale') AS stale_hits, count(*) FILTER (o = 'miss') AS misses, count(*) FILTER (o = 'cold') AS cold_misses, count(*) FILTER (o = 'period') AS period_misses, count(*) FILTER (o IN ('hit', 'stale', 'miss')) AS probes FROM o""")
def cache_counts(spark, sf_dir):
    s, cached, probe = _cache(spark, sf_dir)
    return C.outcome_counts(C.classify(s, cached, probe, "2y"))


@query(f"WITH {SCORES} SELECT sha256(string_agg(symbol, chr(10) ORDER BY true_rank)) AS digest FROM scores")
def ranking_hash(spark, sf_dir):
    return C.ranking_hash(_scores(spark, sf_dir))


_NAMES = "SELECT CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 5 WHEN 0 THEN '.KS' WHEN 1 THEN '.KQ' WHEN 2 THEN '.HK' WHEN 3 THEN '.T' ELSE '' END AS symbol, s_suppkey AS k, s_name AS name FROM supplier"


def _named(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    ending = F.when(k == 0, ".KS").when(k == 1, ".KQ").when(k == 2, ".HK").when(k == 3, ".T").otherwise("")
    return I.table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), ending).alias("symbol"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))


@query(f"""WITH n AS ({_NAMES}) SELECT symbol, CASE WHEN k % 4 = 0 THEN 'cached ' || k WHEN symbol LIKE '%.K_' AND k % 3 > 0 THEN name WHEN k % 7 > 0 THEN 'remote ' || k ELSE symbol END AS name FROM n""")
def name_resolution(spark, sf_dir):
    n = _named(spark, sf_dir)
    text = lambda word, keep: n.where(keep).select("symbol", F.concat(F.lit(word), F.col("k").cast("string")).alias("name"))
    return L.named(n, text("cached ", "k % 4 = 0"), n.where("k % 3 > 0").select("symbol", "name"), text("remote ", "k % 7 > 0"))


@query(r"""WITH r AS (SELECT printf('%06d', s_suppkey / 2) || CASE s_suppkey % 3 WHEN 0 THEN '.KS ' WHEN 1 THEN '.KQ' ELSE '.T' END AS s, ' ' || s_name AS n, s_suppkey AS ord FROM supplier),
u AS (SELECT trim(s) AS symbol, trim(n) AS name, ord FROM r UNION ALL SELECT substr(trim(s), 1, 6) || '.KQ', trim(n), ord FROM r WHERE regexp_matches(trim(s), '^[0-9]{6}\.K[SQ]$'))
SELECT symbol, arg_max(name, ord) AS name FROM u GROUP BY 1""".replace("s_suppkey / 2", "s_suppkey // 2"))
def name_aliases(spark, sf_dir):
    k = F.col("s_suppkey")
    code = F.concat(F.format_string("%06d", F.floor(k / 2)), F.when(k % 3 == 0, ".KS ").when(k % 3 == 1, ".KQ").otherwise(".T"))
    return L.with_aliases(I.table(spark, sf_dir, "supplier").select(code.alias("symbol"), F.concat(F.lit(" "), F.col("s_name")).alias("name"), k.alias("ord")))


@query("""WITH p AS (SELECT CAST(n_nationkey AS BIGINT) + 1 AS page, 12 AS reported, 490 AS total, CASE WHEN n_nationkey = 10 THEN NULL WHEN n_nationkey = 24 THEN 10 ELSE 20 END AS n_rows FROM nation),
s AS (SELECT *, sum(CASE WHEN coalesce(n_rows, 0) < 20 THEN 1 ELSE 0 END) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM p),
k AS (SELECT *, bool_or(n_rows IS NULL) OVER () AS partial FROM s WHERE coalesce(stops, 0) = 0 AND page <= 12) SELECT page, n_rows, partial FROM k WHERE n_rows > 0""")
def scraped_pages(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    rows = F.when(k == 10, F.lit(None).cast("int")).when(k == 24, 10).otherwise(20)
    return L.scraped(I.table(spark, sf_dir, "nation").select((k + 1).alias("page"), F.lit(12).alias("reported"), F.lit(490).alias("total"), rows.alias("n_rows")))


@query("""WITH l AS (SELECT 'HSI' AS source, s_suppkey AS ord, (s_suppkey % 60 + 1)::INTEGER AS code, s_name AS name, s_suppkey % 3 AS w FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'XCEI', s_suppkey, (s_suppkey % 90 + 1)::INTEGER, s_name, s_suppkey % 3 FROM supplier),
r AS (SELECT printf('%04d.HK', code) AS symbol, name, source, row_number() OVER (PARTITION BY code ORDER BY source, ord, name) AS k FROM l) SELECT symbol, name, source FROM r WHERE k = 1""")
def listed_codes(spark, sf_dir):
    k, s = F.col("s_suppkey"), I.table(spark, sf_dir, "supplier")

    def lines(source, rows, n):
        kind = F.when(k % 3 == 0, " Financials H Share").when(k % 3 == 1, " Utilities").otherwise("")
        return rows.select(F.lit(source).alias("source"), k.alias("ord"), F.concat(F.format_string("%05d", (k % n + 1).cast("int")), F.lit("  KYG000000001 "), "s_name", kind, F.lit(" 1.25")).alias("line"))

    both = lines("HSI", s.where("s_suppkey % 2 = 0"), 60).unionByName(lines("XCEI", s, 90)).unionByName(lines("HSI", s, 60).withColumn("line", F.lit("no line of the table")))
    return L.listed_codes(both, ("H Share", "Red Chip"), ("Financials", "Utilities"))


@query(f"WITH {SCORES}, k AS (SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS a, row_number() OVER (ORDER BY score, symbol) AS z FROM scores) SELECT symbol, score, 'top' AS \"end\" FROM k WHERE a <= 5 UNION ALL SELECT symbol, score, 'bottom' FROM k WHERE z <= 5")
def score_extremes(spark, sf_dir):
    return R.extremes(_scores(spark, sf_dir).select("symbol", "score"), "score", 5)


@query(f"WITH {SCORES}, t AS (SELECT *, ntile(3) OVER (ORDER BY true_rank) AS k FROM scores) SELECT count(*) FILTER (score < 3) AS n, round(count(*) FILTER (score < 3 AND k = 3) / count(*) FILTER (score < 3), 6) AS share FROM t")
def low_score_share(spark, sf_dir):
    s = W.tiled(_scores(spark, sf_dir), 3, [F.col("true_rank")], "k")
    return I.rounded(R.share_of(s, F.col("k") == 3, F.col("score") < 3))


@query(f"WITH {SCORES} SELECT param_id, round(avg((inversion < base)::INTEGER), 6) AS win_rate, round(avg(inversion), 6) AS inversion FROM (SELECT true_rank % 6 AS param_id, score AS inversion, (true_rank * 37 % 101)::DOUBLE / 10 AS base FROM scores) GROUP BY 1")
def win_rates(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return I.rounded(R.win_rates(s.select((F.col("true_rank") % 6).alias("param_id"), F.col("score").alias("inversion"), (F.col("true_rank") * 37 % 101 / 10).alias("base_inversion"))))


@query(f"WITH {SCORES}, {WATCH} SELECT symbol FROM watch WHERE symbol IN (SELECT symbol FROM scores WHERE fms <> -999)")
def watchlist_passing(spark, sf_dir):
    return L.passing(_watch(spark, sf_dir), _scores(spark, sf_dir).select("symbol", (F.col("fms") == L.DISQUALIFIED).alias("disqualified")))


@query(f"WITH {SCORES} SELECT symbol, 'too few closes' AS filter_status FROM scores WHERE fms = -999")
def disqualified_symbols(spark, sf_dir):
    return L.disqualified(_scores(spark, sf_dir).select("symbol", F.when(F.col("fms") == L.DISQUALIFIED, "too few closes").otherwise("normal").alias("filter_status")))


@query(f"WITH {SCORES} SELECT symbol, round(score, 2) AS fms, round(score / 7 * 100, 2) AS r_1m, round(score / 11, 3) AS r2_3m, true_rank FROM scores")
def shown_scan(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return L.shown(s.select("symbol", F.col("score").alias("fms"), (F.col("score") / 7).alias("r_1m"), (F.col("score") / 11).alias("r2_3m"), "true_rank"))


@query(f"WITH {SCORES}, {WATCH}, {I.MARKETS} SELECT symbol, market AS country, 'no. ' || symbol AS name FROM watch JOIN markets USING (symbol)")
def watchlist_export(spark, sf_dir):
    rows = _watch(spark, sf_dir).join(I.markets(spark, sf_dir), "symbol")
    return L.exported(rows, F.col("market"), F.concat(F.lit("no. "), F.col("symbol")))


@query(f"WITH {SCORES} SELECT symbol, coalesce(score / 10 - 0.3::DOUBLE <= 0 OR score / 5 - 1 <= 0, false) AS borderline FROM scores WHERE fms <> -999")
def borderline_symbols(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumns({"r_3m": F.col("score") / 10 - 0.3, "r_4m": F.col("score") / 5 - 1})
    return L.borderline(s).select("symbol", "borderline")


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'MMSFT' WHEN p_partkey % 5 = 1 THEN 'AA' || p_partkey ELSE ' XY' || p_partkey || ' ' END AS t, p_partkey AS k FROM part)
SELECT k, CASE WHEN trim(t) = 'MMSFT' THEN 'MSFT' WHEN trim(t) LIKE 'AA%' THEN substr(trim(t), 2) ELSE trim(t) END AS ticker FROM t""")
def repaired_tickers(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 5 == 0, "MMSFT").when(k % 5 == 1, F.concat(F.lit("AA"), k.cast("string"))).otherwise(F.concat(F.lit(" XY"), k.cast("string"), F.lit(" ")))
    return L.repaired(I.table(spark, sf_dir, "part").select(k.alias("k"), t.alias("ticker")))


@query(f"WITH {SCORES} SELECT symbol, concat_ws(',', CASE WHEN score > 5 THEN 'r_1m' END, CASE WHEN score > 3 THEN 'above_ema50' END, CASE WHEN score > 7 THEN 'r_3m' END, CASE WHEN true_rank % 3 = 0 THEN 'd1' END, CASE WHEN true_rank % 4 = 0 THEN 'd5' END) AS badges FROM scores")
def scan_badges(spark, sf_dir):
    s = _scores(spark, sf_dir)
    every = {"r_1m": F.col("score") - 5, "above_ema50": F.col("score") - 3, "r_3m": F.col("score") - 7, "d1": F.when(F.col("true_rank") % 3 == 0, 1.0).otherwise(-1.0), "d5": F.when(F.col("true_rank") % 4 == 0, 1.0).otherwise(0.0)}
    return H.badges(s.withColumns(every))


@query(f"""WITH {SCORES}, k AS (SELECT count(*) AS n, greatest(round_even(count(*) * 0.2::DOUBLE, 0), 1)::BIGINT AS most FROM scores),
b AS (SELECT symbol, true_rank, most, floor((true_rank - 1) / greatest(floor(n / most), 1)) AS bucket, sha256('20260729 ' || symbol) AS draw FROM scores, k)
SELECT symbol, true_rank, draw = min(draw) OVER (PARTITION BY bucket) AND bucket < most AS audit FROM b""")
def audit_split(spark, sf_dir):
    return D.audit_split(_scores(spark, sf_dir).select("symbol", "true_rank"))


@query(f"""WITH {SCORES}, o AS (SELECT array_to_string(list(symbol ORDER BY true_rank), chr(10)) AS r, count(*) AS n FROM scores) SELECT 's1' AS session_id, 'done' AS phase, n AS n_symbols, sha256(r) AS digest FROM o""")
def session_documents(spark, sf_dir):
    """A ranking made by choices that follow the true order, saved, read again and hashed."""
    order = {r["symbol"]: r["true_rank"] for r in _scores(spark, sf_dir).select("symbol", "true_rank").collect()}  # a ranking that people made
    one, two = Session("s1", "snap", sorted(order)), Session("s0", "snap", ["a", "b"])
    while one.next_pair:
        one.choose(min(one.next_pair, key=order.get))
    folder = I.work_dir(spark, "sessions")
    D.save_session(spark, one, folder, "2024-01-02T00:00:00")
    D.save_session(spark, two, folder, "2024-01-03T00:00:00")
    found = D.latest_completed(D.sessions(spark, folder))
    return found.select("session_id", "phase", F.size("final_ranking").cast("long").alias("n_symbols"), F.sha2(F.array_join("final_ranking", "\n"), 256).alias("digest"))


_STORED = "bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_suppkey AS k, CAST(l_shipdate AS DATE) AS date FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_STORED}, old AS (SELECT symbol, any_value(k) AS k, count(*) AS n, max(date) AS d FROM bars WHERE k % 5 <> 0 AND (k % 3 = 0 OR date < DATE '1997-01-01') GROUP BY 1),
fresh AS (SELECT symbol, any_value(k) AS k, count(*) AS n, max(date) AS d FROM bars GROUP BY 1),
o AS (SELECT f.symbol, f.n, f.d, old.n AS old_n, old.d AS old_d, CASE WHEN old.d IS NULL THEN 'cold' WHEN f.k % 4 = 0 OR old.n < 80 THEN 'period_miss' WHEN f.k % 7 = 0 THEN 'stale_hit' WHEN f.d > old.d THEN 'miss' ELSE 'hit' END AS outcome FROM fresh f LEFT JOIN old USING (symbol))
SELECT symbol, outcome, CASE WHEN outcome IN ('hit', 'stale_hit') THEN old_n ELSE n END AS n_bars, CAST(CASE WHEN outcome IN ('hit', 'stale_hit') THEN old_d ELSE d END AS VARCHAR) AS last_date, CASE WHEN outcome IN ('hit', 'stale_hit') THEN CASE WHEN CAST(symbol AS INTEGER) % 4 = 0 THEN '1mo' ELSE '2y' END ELSE '6mo' END AS period FROM o""")
def cache_refresh(spark, sf_dir):
    """Four fifths of the symbols are cached, most up to 1996; all are asked for, what is no hit is read and written back, and
    then everything is read from the cache again."""
    fresh, k = I.prices(spark, sf_dir).select("symbol", "date", "close"), F.col("symbol").cast("int")
    cache = BarCache(spark, I.work_dir(spark, "bars"), 16)
    cache.save("adj_close", fresh.where((k % 5 != 0) & ((k % 3 == 0) | (F.col("date") < "1997-01-01"))), F.when(k % 4 == 0, "1mo").otherwise("2y"), "1999-01-01")
    probe = fresh.where(k % 7 != 0).groupBy("symbol").agg(F.max("date").alias("probe_date"))
    wanted = fresh.select("symbol").distinct()
    _, outcomes = cache.refresh("adj_close", wanted, probe, lambda symbols: fresh.join(symbols, "symbol", "left_semi"), "6mo", "1999-01-02")
    counts = cache.bars("adj_close", wanted).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("date").cast("string").alias("last_date"))
    return outcomes.join(counts, "symbol").join(cache.manifest("adj_close", wanted).select("symbol", "period"), "symbol").select("symbol", "outcome", "n_bars", "last_date", "period")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'old ' || s_suppkey WHEN s_suppkey % 11 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_name END AS name FROM supplier""")
def name_cache(spark, sf_dir):
    """Names saved 40 days ago have expired, a third were saved again 5 days ago; the others are found anew, but for some that no
    source has."""
    s, k = I.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select(k.cast("string").alias("symbol"), k, "s_name")
    cache, old = NameCache(spark, I.work_dir(spark, "names")), F.concat(F.lit("old "), F.col("symbol")).alias("name")
    cache.save(rows.select("symbol", F.concat(F.lit("older "), F.col("symbol")).alias("name")), "2024-01-01")
    cache.save(rows.where(k % 3 == 0).select("symbol", old), "2024-02-05")
    found = rows.where(k % 11 != 0).select("symbol", F.col("s_name").alias("name"))
    return cache.read_through(rows, lambda symbols: found.join(symbols, "symbol", "left_semi"), "2024-02-10")


_TRAITS = f"{SCORES}, traits AS (SELECT symbol, true_rank, score / 100 AS r_3m, (true_rank * 37 % 11) / 10::DOUBLE AS one, CASE WHEN true_rank % 9 > 0 THEN (true_rank * 53 % 7 - 3) / 10::DOUBLE END AS two FROM scores)"
_LONG = f"{_TRAITS}, n AS (SELECT count(*) AS n, greatest(count(*) // 3, 1) AS third FROM traits), placed AS (SELECT traits.*, CASE WHEN true_rank <= third THEN 'TOP' WHEN true_rank > n - third THEN 'BOT' WHEN true_rank <= 2 * third THEN 'MID' END AS grp FROM traits, n), long AS (UNPIVOT placed ON r_3m, one, two INTO NAME feature VALUE v)"


def _traits(spark, sf_dir):
    rank = F.col("true_rank")
    two = F.when(rank % 9 > 0, (rank * 53 % 7 - 3) / 10)
    return _scores(spark, sf_dir).select("symbol", "true_rank", (F.col("score") / 100).alias("r_3m"), (rank * 37 % 11 / 10).alias("one"), two.alias("two"))


@query(f"""WITH {_LONG}, g AS (SELECT feature, avg(v) FILTER (grp = 'TOP') AS t, avg(v) FILTER (grp = 'MID') AS m, avg(v) FILTER (grp = 'BOT') AS b FROM long GROUP BY 1)
SELECT feature, round(t, 6) AS top, round(m, 6) AS mid, round(b, 6) AS bot, round(t - b, 6) AS contrast, CASE WHEN t > m AND m > b THEN 'rising' WHEN t < m AND m < b THEN 'falling' ELSE 'neither' END AS shape FROM g""")
def pattern_contrasts(spark, sf_dir):
    return I.rounded(N.contrasts(_traits(spark, sf_dir)))


_RULES = (("return_floor", "r_3m", "<", 0.02, "BOT", 0.3), ("one_high", "one", ">=", 0.8, "TOP", 0.5), ("two_up", "two", ">", 0.0, "TOP", 0.2), ("never", "one", ">", 9.0, "TOP", 0.1))


@query(f"""WITH {_LONG}, rules(rule, feature, sign, threshold, grp, least) AS (VALUES {", ".join(f"('{r}', '{f}', '{o}', {t}::DOUBLE, '{g}', {m}::DOUBLE)" for r, f, o, t, g, m in _RULES)}),
e AS (SELECT rule, rules.grp AS wanted, least, CASE sign WHEN '<' THEN v < threshold WHEN '<=' THEN v <= threshold WHEN '>' THEN v > threshold ELSE v >= threshold END AS met, coalesce(long.grp = rules.grp, false) AS inside FROM rules JOIN long USING (feature)),
s AS (SELECT rule, least, count(*) AS n, count(*) FILTER (met) AS n_met, count(*) FILTER (met AND inside) AS n_both, count(*) FILTER (inside) AS n_inside FROM e GROUP BY 1, 2)
SELECT rule, n, n_met, n_both, round(n_both / greatest(n_met, 1), 6) AS share, round(n_inside / n, 6) AS base, n_met > 0 AND round(n_both / greatest(n_met, 1), 12) >= least AS holds FROM s""")
def pattern_rules(spark, sf_dir):
    return I.rounded(N.rule_evidence(_traits(spark, sf_dir), N.rules_table(spark, _RULES)))
