"""SQL of stratified plans and estimates, for oracles."""

from __future__ import annotations


def allocation(source: str, keys: str, label: str, population: str, budget: str, minimum: int) -> str:
    """CTEs that end in ``sized`` (source's columns, size): the budget of each group dealt over its strata in proportion."""
    order = f"{keys}, {label}"
    return f"""
        al1 AS (SELECT *, sum({population}) OVER (PARTITION BY {keys}) AS al_total, least({minimum}, {population}) AS al_floor FROM {source}),
        al2 AS (SELECT *, cast(CASE WHEN al_total > 0 THEN least({population}, greatest(al_floor, floor({population}::DOUBLE / al_total::DOUBLE * {budget}::DOUBLE + 0.5::DOUBLE))) ELSE 0 END AS bigint) AS al_size FROM al1),
        al3 AS (SELECT *, cast(sum(al_size) OVER (PARTITION BY {keys}) - {budget} AS bigint) AS al_over FROM al2),
        al_down AS (SELECT {order}, count(*) AS less FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY level DESC, {label}) AS r
            FROM (SELECT {order}, al_over, unnest(range(al_floor + 1, al_size + 1)) AS level FROM al3 WHERE al_over > 0 AND al_size > al_floor)) WHERE r <= al_over GROUP BY {order}),
        al_up AS (SELECT {order}, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY turn, {population} DESC, {label}) AS r
            FROM (SELECT {order}, {population}, al_over, unnest(range(1, cast(least({population} - al_size, -al_over) AS bigint) + 1)) AS turn FROM al3 WHERE al_over < 0 AND {population} > al_size)) WHERE r <= -al_over GROUP BY {order}),
        sized AS (SELECT al3.* EXCLUDE (al_floor, al_size, al_over), cast(al_size - coalesce(less, 0) + coalesce(more, 0) AS bigint) AS size
            FROM al3 LEFT JOIN al_down USING ({order}) LEFT JOIN al_up USING ({order}))"""


def measured(source: str, keys: str) -> str:
    """CTEs that end in ``me`` (a row for each group) from strata (keys, label, population, sampled, hits), all of them sampled."""
    return f"""
        me1 AS (SELECT *, hits::DOUBLE / sampled::DOUBLE AS p, sampled::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM {source}),
        me2 AS (SELECT *, (p + z * z / n / 2.0::DOUBLE) / (1.0::DOUBLE + z * z / n) AS centre, z / (1.0::DOUBLE + z * z / n) * sqrt(p * (1.0::DOUBLE - p) / n + z * z / (4.0::DOUBLE * n * n)) AS half,
            sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - n / population::DOUBLE)) AS shrink FROM me1),
        me3 AS (SELECT *, population::DOUBLE * p AS pp, population::DOUBLE * least(least(1.0::DOUBLE, greatest(0.0::DOUBLE, p - (p - (centre - half)) * shrink)), p) AS pl,
            population::DOUBLE * greatest(least(1.0::DOUBLE, greatest(0.0::DOUBLE, p + ((centre + half) - p) * shrink)), p) AS ph FROM me2),
        me4 AS (SELECT *, cast(floor(pp + 0.5::DOUBLE) AS bigint) AS estimated, cast(floor(pl + 0.5::DOUBLE) AS bigint) AS low, cast(floor(ph + 0.5::DOUBLE) AS bigint) AS high FROM me3),
        me5 AS (SELECT {keys}, cast(sum(population) AS bigint) AS population_count, cast(sum(sampled) AS bigint) AS sample_size, cast(sum(hits) AS bigint) AS observed_count, cast(floor(sum(pp) + 0.5::DOUBLE) AS bigint) AS point_estimate,
            cast(floor(sum(pl) + 0.5::DOUBLE) AS bigint) AS l, cast(floor(sum(ph) + 0.5::DOUBLE) AS bigint) AS h, bool_and(sampled >= population) AND sum(population) > 0 AS is_counted FROM me4 GROUP BY {keys}),
        me6 AS (SELECT * EXCLUDE (l, h), least(l, point_estimate) AS ci_low, greatest(h, point_estimate) AS ci_high FROM me5),
        me7 AS (SELECT *, CASE WHEN point_estimate > 0 THEN (ci_high - ci_low)::DOUBLE / point_estimate WHEN ci_high = ci_low THEN 0 ELSE (ci_high - ci_low)::DOUBLE / population_count END AS width FROM me6),
        me AS (SELECT * EXCLUDE (width), 0.95::DOUBLE AS confidence_level, CASE WHEN is_counted THEN 'counted' ELSE 'estimated' END AS evidence_tier, '1.0.0' AS estimator_version,
            CASE WHEN is_counted OR width < CASE WHEN point_estimate <= 0 THEN 0.02 ELSE 0.2 END THEN 'confident' WHEN width < CASE WHEN point_estimate <= 0 THEN 0.1 ELSE 0.5 END THEN 'approximate' ELSE 'low' END AS confidence_band FROM me7)"""


def expansion(source: str, keys: str) -> str:
    """CTEs that end in ``ex`` (keys, should_expand, reason, additional_total)."""
    return f"""{measured(source, keys)},
        ex1 AS (SELECT *, least(1200 - sample_size, sample_size * 2, cast(floor(population_count * 0.25::DOUBLE) AS bigint) - sample_size) AS room,
            CASE WHEN is_counted OR confidence_band <> 'low' THEN 'already_precise' WHEN sample_size >= 1200 THEN 'at_expansion_ceiling' WHEN floor(population_count * 0.25::DOUBLE) <= sample_size THEN 'at_population_ceiling' END AS gate FROM me),
        ex2 AS (SELECT {keys}, label, population - sampled AS headroom, sampled < population AND (CASE WHEN estimated > 0 THEN (high - low)::DOUBLE / estimated WHEN high = low THEN 0 ELSE (high - low)::DOUBLE / population END) >= 0.5 AS wide, sampled < population AS partial, room
            FROM me4 JOIN (SELECT * FROM ex1 WHERE gate IS NULL) USING ({keys})),
        ex3 AS (SELECT * FROM (SELECT *, bool_or(wide) OVER (PARTITION BY {keys}) AS any_wide FROM ex2) WHERE CASE WHEN any_wide THEN wide ELSE partial END),
        ex4 AS (SELECT {keys}, label, headroom, cast(least(room, sum(headroom) OVER (PARTITION BY {keys})) AS bigint) AS ex_budget FROM ex3),
        {allocation("ex4", keys, "label", "headroom", "ex_budget", 0)},
        ex5 AS (SELECT {keys}, cast(sum(size) AS bigint) AS added FROM sized WHERE size > 0 GROUP BY {keys}),
        ex AS (SELECT {keys}, gate IS NULL AND added IS NOT NULL AS should_expand, coalesce(gate, CASE WHEN added IS NULL THEN 'nothing_left_to_sample' ELSE 'interval_too_wide' END) AS reason, coalesce(added, 0) AS additional_total
            FROM ex1 LEFT JOIN ex5 USING ({keys}))"""


#: Openings of refusal circuits, host by host and probe by probe.
CIRCUITS = """
    WITH RECURSIVE p AS (SELECT host, seq, seq * 30.0::DOUBLE AS sec, coalesce(status, 0) AS status, row_number() OVER (PARTITION BY host ORDER BY seq) AS k FROM probe),
    c(host, k, seq, streak, prior, until, reason) AS (
        SELECT host, 0::BIGINT, 0::BIGINT, 0, 0, '-infinity'::DOUBLE, NULL::VARCHAR FROM (SELECT DISTINCT host FROM probe)
        UNION ALL
        SELECT host, k, seq, CASE WHEN opened THEN 0 ELSE new_streak END, CASE WHEN closed THEN prior WHEN refused AND NOT opened THEN status ELSE 0 END, CASE WHEN opened THEN sec + 300 ELSE until END,
            CASE WHEN opened THEN CASE status WHEN 429 THEN 'TOO_MANY_REQUESTS' ELSE 'FORBIDDEN' END END
        FROM (SELECT *, refused AND new_streak >= CASE status WHEN 429 THEN 5 ELSE 10 END AS opened
            FROM (SELECT p.host, p.k, p.seq, p.sec, p.status, c.prior, c.until, p.sec < c.until AS closed, p.sec >= c.until AND p.status IN (429, 403) AS refused,
                CASE WHEN p.sec < c.until THEN c.streak WHEN p.status NOT IN (429, 403) THEN 0 WHEN p.status = c.prior THEN c.streak + 1 ELSE 1 END AS new_streak
                FROM c JOIN p ON p.host = c.host AND p.k = c.k + 1)))
    SELECT host, seq AS opened_seq, reason FROM c WHERE reason IS NOT NULL"""

#: The verdict of each pattern: the first trigger decides.
VERDICTS = """
    WITH g AS (SELECT *, CASE status WHEN 429 THEN 'TOO_MANY_REQUESTS' WHEN 403 THEN 'FORBIDDEN' END AS refusal FROM probe),
    i AS (SELECT *, sum(CASE WHEN coalesce(refusal, '') <> coalesce(before, '') THEN 1 ELSE 0 END) OVER (PARTITION BY host, pattern_id ORDER BY seq) AS island FROM (SELECT *, lag(refusal) OVER (PARTITION BY host, pattern_id ORDER BY seq) AS before FROM g)),
    r AS (SELECT *, row_number() OVER (PARTITION BY host, pattern_id, island ORDER BY seq) AS in_a_row, sum(escalated::INT) OVER (PARTITION BY pattern_id ORDER BY seq) AS used FROM i),
    t AS (SELECT *, CASE WHEN refusal IS NOT NULL AND in_a_row >= CASE refusal WHEN 'FORBIDDEN' THEN 10 ELSE 5 END THEN refusal WHEN status IN (400, 405, 501) AND used > greatest(1, ceil(planned * 0.2)) THEN 'HEAD_NOT_SUPPORTED' END AS trigger FROM r)
    SELECT pattern_id, arg_min(trigger, seq) FILTER (trigger IS NOT NULL) AS reason, count(*) AS probed, count(*) FILTER (escalated) AS escalated, count(*) FILTER (escalated AND status BETWEEN 200 AND 299) AS soft404_sniffed,
        count(*) FILTER (NOT escalated AND status BETWEEN 200 AND 299) AS soft404_suppressed,
        CASE arg_min(trigger, seq) FILTER (trigger IS NOT NULL) WHEN 'HEAD_NOT_SUPPORTED' THEN 'needs_review' WHEN 'FORBIDDEN' THEN 'blocked' WHEN 'TOO_MANY_REQUESTS' THEN 'blocked' ELSE 'measured' END AS verdict
    FROM t GROUP BY pattern_id"""
