"""Check statements: the registered queries written once more as plain SQL, by the direct method.

Where the library avoids pairs or whole-group windows, the statement here uses them, so the two
share no method.  Frames that several statements need are the common table expressions in SHARED.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidemark import config
from tidemark.functions.replicates import BALL, MULTIPLIER, POISSON_CUTS
from tidemark.plans.roles import with_roles

T = config.PREDICTION_HOUR
H = config.HORIZON_HOURS
STUDY_HOURS = 720  # the event stream is followed for 30 days
N_BOOT = config.N_BOOT
N_PARTS = 600  # draws of the variance decomposition


def values(rows: Sequence[tuple]) -> str:
    def cell(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def any_like(column: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{column} LIKE '{p}'" for p in patterns) + ")"


def quoted(words: Sequence[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def check(body: str, doubles: Sequence[str] = ()) -> str:
    """Final statement: doubles rounded like the registered queries, roles and shared frames in front."""
    if doubles:
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in doubles)
        body = f"SELECT * REPLACE ({rounded}) FROM ({body})"
    return with_roles(body, SHARED)


def concept_map(concepts: dict) -> str:
    rows = [(i, n, float(s["valid"][0]), float(s["valid"][1])) for n, s in concepts.items() for i in s["itemids"]]
    return f"SELECT * FROM (VALUES {values(rows)}) AS t(itemid, concept, lo, hi)"


HOURS = "date_diff('second', c.intime, {t}) / 3600e0"
MS = "CAST(round(hours * 3600000e0) AS BIGINT)"
ABX = (f"({' OR '.join(f'contains(lower(p.drug), {quoted([s])})' for s in config.ANTIBIOTIC_STEMS)})"
       f" AND (p.route IS NULL OR upper(p.route) NOT IN ({quoted(config.EXCLUDED_ROUTES)}))")
SYSTEMIC = f"upper(p.route) IN ({quoted(config.SYSTEMIC_ROUTES)})"
NOT_SURVEILLANCE = (" AND ".join(f"upper(m.spec_type_desc) NOT LIKE '{p}'" for p in config.SURVEILLANCE_PATTERNS)
                    + " AND " + " AND ".join(f"upper(m.spec_type_desc) <> '{s}'" for s in config.SURVEILLANCE_EXACT))
STERILE = f"upper(m.spec_type_desc) IN ({quoted(config.STERILE_SITES)})"


def actions(kind: str, where: str) -> str:
    if kind == "abx":
        return f"""SELECT DISTINCT c.stay_id, {HOURS.format(t='p.starttime')} AS hours
            FROM prescriptions p JOIN cohort c ON c.hadm_id = p.hadm_id
            WHERE {ABX} AND {where} AND p.starttime BETWEEN c.intime - INTERVAL 24 HOUR AND c.intime + INTERVAL {STUDY_HOURS} HOUR"""
    t = "coalesce(m.charttime, CAST(m.chartdate AS TIMESTAMP))"
    return f"""SELECT DISTINCT c.stay_id, {HOURS.format(t=t)} AS hours
        FROM microbiologyevents m JOIN cohort c ON c.hadm_id = m.hadm_id
        WHERE {where} AND {t} BETWEEN c.intime - INTERVAL 24 HOUR AND c.intime + INTERVAL {STUDY_HOURS} HOUR"""


def card(column: str, cuts, direction: str) -> str:
    op = "<" if direction == "below" else ">="
    return (f"CASE WHEN {column} IS NULL THEN NULL "
            + " ".join(f"WHEN {column} {op} {cut} THEN {points}" for cut, points in cuts) + " ELSE 0 END")


def cohort_sql(stays: str, patients: str, admissions: str) -> str:
    return f"""
        SELECT i.subject_id, i.hadm_id, i.stay_id, i.intime, i.outtime, i.los * 24e0 AS los_hours, p.gender,
               p.anchor_year_group AS epoch, CAST(p.anchor_age + (year(a.admittime) - p.anchor_year) AS INTEGER) AS age,
               CAST(year(i.intime) - p.anchor_year AS INTEGER) AS anchor_offset_years, a.admission_type, a.hospital_expire_flag
        FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS rk FROM {stays}) i
        JOIN {patients} p ON p.subject_id = i.subject_id JOIN {admissions} a ON a.hadm_id = i.hadm_id
        WHERE i.rk = 1 AND i.los * 24e0 >= 12 AND p.anchor_age + (year(a.admittime) - p.anchor_year) >= 18"""


def scores_sql(inputs: str, stays: str) -> str:
    """Hourly score from a long frame (stay_id, concept, hours, value) with pf already as a concept."""
    rates = ["norepinephrine", "epinephrine", "dopamine", "dobutamine"]
    pick = lambda f, c: f"{f}(CASE WHEN concept = '{c}' THEN value END)"
    worst = lambda f, c, n: f"{f}({c}) OVER (PARTITION BY g.stay_id ORDER BY g.hour ROWS {n - 1} PRECEDING)"
    return f"""
        WITH bins AS (
            SELECT stay_id, CAST(floor(hours) AS INTEGER) AS hour, {pick('min', 'pf')} AS pf, {pick('max', 'ventilated')} AS vent,
                   {pick('min', 'platelets')} AS plt, {pick('max', 'bilirubin_total')} AS bili, {pick('max', 'creatinine')} AS crea,
                   {pick('min', 'map')} AS mapp, {pick('min', 'gcs')} AS gcs, {pick('sum', 'urine')} AS uo,
                   {', '.join(f"{pick('max', 'rate_' + r)} AS {r}" for r in rates)}
            FROM {inputs} GROUP BY 1, 2),
        grid AS (SELECT stay_id, CAST(unnest(generate_series(0, CAST(ceil(max_hours) AS BIGINT))) AS INTEGER) AS hour FROM {stays}),
        w AS (
            SELECT g.stay_id, g.hour, {worst('min', 'pf', 24)} AS pf_ratio, coalesce({worst('max', 'vent', 24)} > 0, false) AS ventilated,
                   {worst('min', 'plt', 24)} AS platelets, {worst('max', 'bili', 24)} AS bilirubin, {worst('max', 'crea', 24)} AS creatinine,
                   {worst('min', 'mapp', 4)} AS map, {worst('min', 'gcs', 4)} AS gcs,
                   {', '.join(rates)},
                   CASE WHEN {worst('count', '*', 24)} = 24 AND {worst('count', 'uo', 24)} >= 6 THEN {worst('sum', 'uo', 24)} END AS urine_24h
            FROM grid g LEFT JOIN bins b ON b.stay_id = g.stay_id AND b.hour = g.hour),
        s AS (
            SELECT *,
                CASE WHEN pf_ratio IS NULL THEN NULL WHEN pf_ratio < 100 AND ventilated THEN 4 WHEN pf_ratio < 200 AND ventilated THEN 3
                     WHEN pf_ratio < 300 THEN 2 WHEN pf_ratio < 400 THEN 1 ELSE 0 END AS sofa_resp,
                {card('platelets', [(20, 4), (50, 3), (100, 2), (150, 1)], 'below')} AS sofa_coag,
                {card('bilirubin', [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)], 'from')} AS sofa_liver,
                CASE WHEN map IS NULL AND norepinephrine IS NULL AND epinephrine IS NULL AND dopamine IS NULL AND dobutamine IS NULL THEN NULL
                     WHEN dopamine > 15 OR norepinephrine > 0.1 OR epinephrine > 0.1 THEN 4
                     WHEN dopamine > 5 OR norepinephrine > 0 OR epinephrine > 0 THEN 3
                     WHEN dopamine > 0 OR dobutamine > 0 THEN 2 WHEN map < 70 THEN 1 ELSE 0 END AS sofa_cardio,
                {card('gcs', [(6, 4), (10, 3), (13, 2), (15, 1)], 'below')} AS sofa_cns,
                greatest({card('creatinine', [(5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1)], 'from')},
                         {card('urine_24h', [(200, 4), (500, 3)], 'below')}) AS sofa_renal
            FROM w)
        SELECT *, coalesce(sofa_resp, 0) + coalesce(sofa_coag, 0) + coalesce(sofa_liver, 0) + coalesce(sofa_cardio, 0)
                  + coalesce(sofa_cns, 0) + coalesce(sofa_renal, 0) AS sofa_total,
               CAST(sofa_resp IS NULL AS INTEGER) + CAST(sofa_coag IS NULL AS INTEGER) + CAST(sofa_liver IS NULL AS INTEGER)
               + CAST(sofa_cardio IS NULL AS INTEGER) + CAST(sofa_cns IS NULL AS INTEGER) + CAST(sofa_renal IS NULL AS INTEGER) AS sofa_components_missing
        FROM s"""


def over_baseline(sofa: str, hour: float, rule: str, after: bool = True, increase: int = 2) -> str:
    base = {"zero": "0", "min_before": f"min(CASE WHEN hour <= {hour} THEN sofa_total END)",
            "at_prediction": f"arg_max(sofa_total, hour) FILTER (WHERE hour <= {hour})"}[rule]
    tail = f" AND s.hour > {hour}" if after else ""
    return f"""SELECT s.stay_id, s.hour, s.sofa_total, b.base FROM {sofa} s
        JOIN (SELECT stay_id, {base} AS base FROM {sofa} GROUP BY stay_id) b ON b.stay_id = s.stay_id
        WHERE s.sofa_total - b.base >= {increase}{tail}"""


def organ_onset(sofa: str, hour: float = T, rule: str = "at_prediction") -> str:
    return f"""SELECT stay_id, CAST(min(hour) AS DOUBLE) AS onset_hours, arg_min(sofa_total, hour) AS onset_sofa, any_value(base) AS baseline_sofa
        FROM ({over_baseline(sofa, hour, rule)}) GROUP BY stay_id"""


def sepsis_onset(sofa: str, pairs: str, hour: float = T, rule: str = "at_prediction", onset: str = "later_of_both") -> str:
    value = {"later_of_both": "greatest(p.suspicion_hours, d.hour)", "suspicion": "p.suspicion_hours", "sofa": "CAST(d.hour AS DOUBLE)"}[onset]
    return f"""SELECT stay_id, onset_hours, suspicion_hours, dysfunction_hours FROM (
            SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY onset_hours, suspicion_hours, dysfunction_hours) AS rk FROM (
                SELECT p.stay_id, {value} AS onset_hours, p.suspicion_hours, CAST(d.hour AS DOUBLE) AS dysfunction_hours
                FROM (SELECT DISTINCT stay_id, suspicion_hours FROM {pairs}) p
                JOIN ({over_baseline(sofa, hour, rule)}) d ON d.stay_id = p.stay_id
                WHERE d.hour - p.suspicion_hours BETWEEN -48 AND 24) WHERE onset_hours > {hour}) WHERE rk = 1"""


def prevalent_sepsis(sofa: str, pairs: str, rule: str, hour: float = T) -> str:
    base = "zero" if rule == "sofa_at_threshold" else "min_before"
    return f"""SELECT DISTINCT p.stay_id FROM {pairs} p JOIN ({over_baseline(sofa, hour, base, after=False)}) d ON d.stay_id = p.stay_id
        WHERE p.suspicion_hours <= {hour} AND d.hour <= {hour} AND d.hour - p.suspicion_hours BETWEEN -48 AND 24"""


def prevalent_organ(sofa: str, rule: str, hour: float = T) -> str:
    at = f"arg_max(sofa_total, hour) FILTER (WHERE hour <= {hour})"
    low = f"min(CASE WHEN hour <= {hour} THEN sofa_total END)"
    level = at if rule == "sofa_at_threshold" else f"{at} - {low}"
    return f"SELECT stay_id FROM {sofa} GROUP BY stay_id HAVING {level} >= 2"


def creatinine_sql(rows: str, baseline: str = "rolling_min_7d") -> str:
    ms = MS
    base = (f"min(value) OVER (PARTITION BY stay_id ORDER BY {ms} RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW)"
            if baseline == "rolling_min_7d" else
            "first_value(value) OVER (PARTITION BY stay_id ORDER BY hours < 0, hours, value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    if baseline != "rolling_min_7d":
        base = f"CASE WHEN max(hours) OVER (PARTITION BY stay_id) >= 0 THEN {base} END"
    return f"""SELECT stay_id, hours, value, base_7d, min_48h,
            CASE WHEN value / base_7d >= 3 OR value >= 4.0 THEN 3 WHEN value / base_7d >= 2 THEN 2
                 WHEN value / base_7d >= 1.5 OR value >= min_48h + 0.3e0 THEN 1 ELSE 0 END AS stage
        FROM (SELECT stay_id, hours, value, {base} AS base_7d,
                     min(value) OVER (PARTITION BY stay_id ORDER BY {ms} RANGE BETWEEN 172799999 PRECEDING AND CURRENT ROW) AS min_48h
              FROM {rows} WHERE value IS NOT NULL)"""


def urine_sql(rows: str, weight: str) -> str:
    parts, rates = [], []
    for w in (6, 12, 24):
        ms = w * 3600000
        over = f"OVER (PARTITION BY u.stay_id ORDER BY u.ms RANGE BETWEEN {ms - 1} PRECEDING AND CURRENT ROW)"
        older = f"OVER (PARTITION BY u.stay_id ORDER BY u.ms RANGE BETWEEN UNBOUNDED PRECEDING AND {ms} PRECEDING)"
        parts.append(f"sum(u.value) {over} AS v{w}, count(*) {over} AS n{w}, u.hours - coalesce(max(u.hours) {older}, 0) AS c{w}")
        rates.append(f"CASE WHEN c{w} BETWEEN {0.75 * w} AND {w} / 0.75e0 AND n{w} >= {w / 4.0} THEN v{w} / c{w} / weight_kg END AS rate_{w}h")
    return f"""SELECT *, rate_6h IS NOT NULL OR rate_12h IS NOT NULL OR rate_24h IS NOT NULL AS evaluable,
            CASE WHEN rate_6h IS NULL AND rate_12h IS NULL AND rate_24h IS NULL THEN NULL
                 WHEN rate_24h < 0.3 OR rate_12h <= 0 THEN 3 WHEN rate_12h < 0.5 THEN 2 WHEN rate_6h < 0.5 THEN 1 ELSE 0 END AS stage
        FROM (SELECT stay_id, hours, value, weight_kg, {', '.join(rates)}
              FROM (SELECT u.*, w.weight_kg, {', '.join(parts)}
                    FROM (SELECT *, {MS} AS ms FROM {rows} WHERE value >= 0) u LEFT JOIN {weight} w ON w.stay_id = u.stay_id))"""


def first_stage(staged: str) -> str:
    return f"""SELECT stay_id, hours AS onset_hours, stage AS onset_stage FROM (
        SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY hours, stage DESC) AS rk FROM {staged} WHERE stage >= 1) WHERE rk = 1"""


def onsets_union(onsets: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS label, stay_id, onset_hours FROM ({sql})" for n, sql in onsets.items())


def onset_counts(onsets: dict[str, str], cohort: str, group: str, hour: float, horizons: Sequence[float]) -> str:
    names = values([(n,) for n in onsets])
    events = ", ".join(f"count(*) FILTER (WHERE onset_hours > {hour} AND onset_hours <= {h}) AS n_events_{int(h)}h" for h in horizons)
    shares = ", ".join(f"n_events_{int(h)}h / nullif(n_stays - n_onset_early, 0) AS prevalence_{int(h)}h" for h in horizons)
    return f"""SELECT *, n_onset_early / nullif(n_ever_onset, 0) AS frac_early_of_onsets, n_stays - n_onset_early AS n_eligible,
            n_onset_early / n_stays AS frac_lost_to_early, {shares}
        FROM (SELECT l.label, c.{group}, count(*) AS n_stays, count(onset_hours) AS n_ever_onset,
                     count(*) FILTER (WHERE onset_hours <= {hour}) AS n_onset_early, {events},
                     quantile_cont(onset_hours, 0.25) AS onset_hours_q25, quantile_cont(onset_hours, 0.5) AS onset_hours_median,
                     quantile_cont(onset_hours, 0.75) AS onset_hours_q75
              FROM {cohort} c CROSS JOIN (VALUES {names}) AS l(label)
              LEFT JOIN ({onsets_union(onsets)}) o ON o.stay_id = c.stay_id AND o.label = l.label GROUP BY 1, 2)"""


def hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def auroc_sql(rows: str, keys: Sequence[str]) -> str:
    k = ", ".join(keys) + ", " if keys else ""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {k}sum(p) AS n_pos, sum(q) AS n_neg, sum(p * (below + q / 2e0)) / nullif(sum(p) * sum(q), 0) AS auroc
        FROM (SELECT *, coalesce(sum(q) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
              FROM (SELECT {k}score, sum(w * y) AS p, sum(w * (1e0 - y)) AS q FROM {rows} GROUP BY {k}score)) {group}"""


def poisson_sql(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(POISSON_CUTS)) + f" ELSE {len(POISSON_CUTS)} END"


def mixed_sql(rows: str) -> str:
    """The rows with the 32-bit mixing function applied to their column c."""
    for _ in range(2):
        rows = f"SELECT * REPLACE ((xor(c, c >> 16) * {MULTIPLIER}) & 4294967295 AS c) FROM ({rows})"
    return f"SELECT * REPLACE (xor(c, c >> 16) AS c) FROM ({rows})"


def poisson_weights_sql(keys: str, key: str) -> str:
    """(key, rep, w) of seed 0: a Poisson(1) weight from the draw's word mixed with the two words of the key's hash."""
    half = lambda i: f"CAST('0x' || substr(md5('0:' || {key}), {i}, 8) AS BIGINT)"
    pairs = f"SELECT {key}, {half(1)} AS a, {half(9)} AS b, rep, rep AS c FROM (SELECT {key}, unnest(generate_series(0, {N_BOOT})) AS rep FROM {keys})"
    drawn = mixed_sql(f"SELECT * REPLACE (xor(c, b) AS c) FROM ({mixed_sql(f'SELECT * REPLACE (xor(c, a) AS c) FROM ({mixed_sql(pairs)})')})")
    return f"SELECT {key}, rep, CASE WHEN rep = 0 THEN 1 ELSE {poisson_sql('((c + 0.5e0) / 4294967296e0)')} END AS w FROM ({drawn})"


def tree_ctes(name: str, keys: str, key: str, levels: int) -> dict[str, str]:
    """Frames of the exact resampling of seed 0 for up to 2^(levels + 1) - 1 keys; `<name>_w` is (key, rep, w)."""
    n = f"(SELECT count(*) FROM {name}_i)"
    word = lambda rows, tag: mixed_sql(f"SELECT * REPLACE (xor(c, {tag}) AS c) FROM ({rows})")
    ball = mixed_sql(f"SELECT rep, xor(c, j) AS c, j FROM {name}_state CROSS JOIN (SELECT i AS j FROM {name}_i)")
    out = {
        f"{name}_i": f"SELECT {key}, row_number() OVER (ORDER BY {hash_sql(f"CAST({key} AS VARCHAR)")}, {key}) - 1 AS i FROM (SELECT DISTINCT {key} FROM {keys})",
        f"{name}_state": mixed_sql(f"SELECT unnest(generate_series(1, {N_BOOT})) AS rep, unnest(generate_series(1, {N_BOOT})) AS c"),
        f"{name}_parts": f"SELECT k, ({n} >> (k + 1)) << (k + 1) AS first FROM (SELECT unnest(generate_series(0, {levels})) AS k) WHERE ({n} >> k) % 2 = 1",
        f"{name}_balls": f"""SELECT a.rep, floor((a.c * 2097152 + (b.c >> 11)) / 9007199254740992e0 * {n}) AS place
            FROM ({word(ball, BALL)}) a JOIN ({word(ball, BALL + 1)}) b ON b.rep = a.rep AND b.j = a.j""",
        f"{name}_t0": f"SELECT rep, k, 0 AS node, count(*) AS n FROM {name}_balls JOIN {name}_parts ON place >= first AND place < first + (1 << k) GROUP BY rep, k",
    }
    for level in range(levels):
        digits = f"""SELECT t.rep, k, node, n, digit, xor(s.c, node) AS c FROM (
            SELECT *, unnest(list_filter(range(24), lambda d: (n >> d) % 2 = 1)) AS digit FROM {name}_t{level} WHERE k > {level} AND n > 0) t JOIN {name}_state s ON s.rep = t.rep"""
        drawn = mixed_sql(f"SELECT * REPLACE (xor(c, (k << 12) + {level << 6} + digit) AS c) FROM ({mixed_sql(digits)})")
        half = """CASE WHEN w.digit <= 5 THEN bit_count(c & ((1 << (1 << least(w.digit, 5))) - 1))
            ELSE len(list_filter(cdf, lambda p: p <= (c + 0.5e0) / 4294967296e0)) END"""
        left = f"SELECT rep, k, node, n, sum({half}) AS l FROM ({drawn}) w LEFT JOIN half_cdf h ON h.digit = w.digit GROUP BY rep, k, node, n"
        out[f"{name}_t{level + 1}"] = f"""SELECT rep, k, 2 * node + side AS node, CAST(CASE WHEN side = 0 THEN l ELSE n - l END AS BIGINT) AS n
            FROM ({left}) CROSS JOIN (VALUES (0), (1)) AS v(side)"""
    leaves = " UNION ALL ".join(f"SELECT rep, k, node, n FROM {name}_t{k} WHERE k = {k}" for k in range(levels + 1))
    out[f"{name}_w"] = f"""SELECT {key}, rep, n AS w FROM ({leaves}) t JOIN {name}_parts p ON p.k = t.k JOIN {name}_i x ON x.i = p.first + t.node
        UNION ALL SELECT {key}, 0, 1 FROM {name}_i"""
    return out


#: Cumulative probabilities of Binomial(2^digit, 1/2), from value 0 on.
HALF_CDF = """SELECT digit, list(total ORDER BY x) AS cdf FROM (
    SELECT digit, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2e0))) OVER (PARTITION BY digit ORDER BY x) AS total
    FROM (SELECT digit, 1 << digit AS n, unnest(range((1 << digit) + 1)) AS x FROM (SELECT unnest(generate_series(6, 12)) AS digit))) GROUP BY digit"""


def resampled_ctes(name: str, weights: str, key: str) -> dict[str, str]:
    """AUROC, gap and draws of every replicate under (key, rep, w) weights."""
    return {
        f"{name}_auroc": auroc_sql(f"(SELECT p.*, u.rep, u.w FROM pred p JOIN {weights} u ON u.{key} = p.{key} WHERE u.w > 0)", ["rep", "label", "model", "seed", "kind"]),
        f"{name}_gaps": f"""SELECT rep, label, model, seed, max(CASE WHEN kind = 'oracle' THEN auroc END) - max(CASE WHEN kind = 'transferred' THEN auroc END) AS gap
            FROM {name}_auroc GROUP BY 1, 2, 3, 4""",
        f"{name}_draws": draws_sql(f"{name}_gaps", "toxic", "quality"),
    }


def one_feature_fits(rows: str, settings: Sequence[tuple[float, str | None]]) -> str:
    """Logistic regressions of one feature by twelve Newton steps: per (label, training_set) of `rows` (label, training_set, x, y) and setting.

    Columns mean, sd and b0, b1 on the scaled feature, coefficient and intercept on the plain one.
    """
    listed = values([(c, w or "plain") for c, w in settings])
    return f"""WITH RECURSIVE cfg AS (SELECT CAST(c AS DOUBLE) AS C, w = 'balanced' AS balanced FROM (VALUES {listed}) AS v(c, w)),
        st AS (SELECT label, training_set, avg(x) AS mean, stddev_pop(x) AS sd, count(*) AS n, sum(y) AS p FROM {rows} GROUP BY 1, 2),
        zs AS (SELECT r.label, r.training_set, (x - mean) / sd AS z, y, CASE WHEN y = 1 THEN n / (2e0 * p) ELSE n / (2e0 * (n - p)) END AS even
               FROM {rows} r JOIN st ON st.label = r.label AND st.training_set = r.training_set),
        b AS (SELECT label, training_set, C, balanced, 0 AS step, 0e0 AS b0, 0e0 AS b1 FROM st CROSS JOIN cfg
            UNION ALL
            SELECT label, training_set, C, balanced, step + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
            FROM (SELECT label, training_set, C, balanced, step, b0, b1, sum(w * (p - y)) AS g0, sum(w * (p - y) * z) + b1 / C AS g1,
                         sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * z) AS h01, sum(w * p * (1 - p) * z * z) + 1 / C AS h11
                  FROM (SELECT b.*, zs.z, zs.y, CASE WHEN balanced THEN even ELSE 1e0 END AS w, 1 / (1 + exp(-(b0 + b1 * zs.z))) AS p
                        FROM b JOIN zs ON zs.label = b.label AND zs.training_set = b.training_set WHERE step < 12)
                  GROUP BY label, training_set, C, balanced, step, b0, b1))
        SELECT b.label, b.training_set, C, balanced, mean, sd, b0, b1, b1 / sd AS coefficient, b0 - b1 * mean / sd AS intercept
        FROM b JOIN st ON st.label = b.label AND st.training_set = b.training_set WHERE step = 12"""


def scored_sql(rows: str, fits: str, on: str, columns: str) -> str:
    return f"SELECT {columns}, r.y, 1 / (1 + exp(-(b0 + b1 * (r.x - mean) / sd))) AS score FROM {rows} r JOIN {fits} f ON f.label = r.label AND {on}"


TUNED = [(config.TUNED_LOGREG["C"], config.TUNED_LOGREG["class_weight"])]
PART_FRACTIONS = [f for f in config.LEARNING_FRACTIONS if f < 1]
FOLD_NUMBERS = f"(SELECT unnest(generate_series(0, {config.N_FOLDS - 1})) AS k)"


def model_ctes() -> dict[str, str]:
    """The model layer with one feature: training sets as rows, fits, scores."""
    seeds = f"(SELECT unnest(generate_series(0, {config.N_SEEDS - 1})) AS s)"
    ranked = lambda salt, part: f"row_number() OVER (PARTITION BY {part} ORDER BY {hash_sql(f'({salt}) || chr(58) || stay_id')}, stay_id)"
    share = (config.N_FOLDS - 1) / config.N_FOLDS
    fractions = f"(SELECT unnest([{', '.join(map(repr, PART_FRACTIONS))}]) AS f)"
    sizes = "(VALUES ('full'), ('matched'), ('event_matched')) AS z(training_size)"
    return {
        "one_rows": f"""SELECT stay_id, era, CAST(embedding[1] AS DOUBLE) AS x, {hash_sql("'0:' || stay_id")} % {config.N_FOLDS} AS fold, label, CASE label WHEN 'y_low' THEN y_low ELSE y_even END AS y
            FROM vectors CROSS JOIN (VALUES ('y_low'), ('y_even')) AS l(label)""",
        "fold_set": f"SELECT label, k AS training_set, x, y FROM one_rows JOIN {FOLD_NUMBERS} ON fold <> k",
        "fold_fits": one_feature_fits("fold_set", config.LOGREG_CONFIGS),
        "tuned_scores": scored_sql("one_rows", "fold_fits", "f.training_set = r.fold",
                                   "'C=' || CAST(C AS VARCHAR) || CASE WHEN balanced THEN ' balanced' ELSE ' plain' END AS config, r.label, r.fold"),
        "tuned": f"""SELECT config, avg(auroc) AS mean_auroc FROM (SELECT config, label, avg(auroc) AS auroc FROM (
            {auroc_sql('(SELECT *, 1 AS w FROM tuned_scores)', ['config', 'label', 'fold'])}) GROUP BY 1, 2) GROUP BY 1""",
        "one_wanted": f"""SELECT label, CAST(round_even({share!r}::DOUBLE * count(*), 0) AS BIGINT) AS n, CAST(round_even({share!r}::DOUBLE * sum(y), 0) AS BIGINT) AS p
            FROM one_rows WHERE era = 2 GROUP BY 1""",
        "one_set": f"""SELECT label, 'fold' || k AS training_set, x, y FROM one_rows JOIN {FOLD_NUMBERS} ON fold <> k WHERE era = 2
            UNION ALL SELECT label, 'full' || s, x, y FROM one_rows CROSS JOIN {seeds} WHERE era <> 2
            UNION ALL SELECT r.label, 'matched' || s, x, y FROM (SELECT *, {ranked('1000 + s', 's, label')} AS rk FROM one_rows CROSS JOIN {seeds} WHERE era <> 2) r
                JOIN one_wanted w ON w.label = r.label WHERE rk <= n
            UNION ALL SELECT r.label, 'event_matched' || s, x, y FROM (SELECT *, {ranked('2000 + s', 's, label, y')} AS rk FROM one_rows CROSS JOIN {seeds} WHERE era <> 2) r
                JOIN one_wanted w ON w.label = r.label WHERE rk <= CASE WHEN y = 1 THEN p ELSE n - p END""",
        "one_fits": one_feature_fits("one_set", TUNED),
        "one_test": f"SELECT r.*, s, training_size FROM one_rows r CROSS JOIN {seeds} CROSS JOIN {sizes} WHERE era = 2",
        "one_scores": scored_sql("one_test", "one_fits", "f.training_set = r.training_size || r.s", "r.label, CAST(r.s AS INTEGER) AS seed, r.training_size, 'transferred' AS kind")
                      + " UNION ALL " + scored_sql("one_test", "one_fits", "f.training_set = 'fold' || r.fold", "r.label, CAST(r.s AS INTEGER), r.training_size, 'oracle'"),
        "curve_set": f"""SELECT label, k || ':' || s || ':' || f AS training_set, x, y
            FROM (SELECT *, {ranked('7000 + 100 * s + k', 's, k, label')} AS rk, count(*) OVER (PARTITION BY s, k, label) AS n
                  FROM one_rows JOIN {FOLD_NUMBERS} ON fold <> k CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) WHERE era = 2)
            CROSS JOIN {fractions} WHERE rk <= greatest(CAST(round_even(f * n, 0) AS BIGINT), {config.MIN_LEARNING_ROWS})
            UNION ALL SELECT label, k || ':' || s || ':1.0', x, y FROM one_rows JOIN {FOLD_NUMBERS} ON fold <> k CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) WHERE era = 2""",
        "curve_fits": one_feature_fits("curve_set", TUNED),
        "curve_scores": scored_sql("one_rows", "curve_fits", "CAST(split_part(f.training_set, ':', 1) AS INTEGER) = r.fold AND era = 2",
                                   "r.label, CAST(split_part(f.training_set, ':', 3) AS DOUBLE) AS fraction, CAST(split_part(f.training_set, ':', 2) AS INTEGER) AS seed"),
    }


def draws_sql(gaps: str, a: str, b: str, n_boot: int = N_BOOT) -> str:
    """draw_both, draw_units, draw_seeds per replicate from (rep, label, model, seed, gap)."""
    def did(rows: str, name: str) -> str:
        side = lambda l: f"(sum(gap * ws) FILTER (WHERE label = '{l}') / nullif(sum(ws) FILTER (WHERE label = '{l}' AND gap IS NOT NULL), 0))"
        return f"""SELECT rep, CASE WHEN count(d) = count(*) THEN avg(d) END AS {name}
            FROM (SELECT rep, model, {side(a)} - {side(b)} AS d FROM ({rows}) GROUP BY rep, model) GROUP BY rep"""

    ws = f"""SELECT d.rep, c.model, c.seed, d.ws
        FROM (SELECT model, seed, row_number() OVER (PARTITION BY model ORDER BY seed) - 1 AS i FROM (SELECT DISTINCT model, seed FROM {gaps})) c
        JOIN (SELECT model, rep, {hash_sql("'0:seed:' || rep || ':' || model || ':' || j")} % k AS i, count(*) AS ws
              FROM (SELECT model, count(DISTINCT seed) AS k, unnest(generate_series(1, {n_boot})) AS rep FROM {gaps} GROUP BY model) m
              JOIN (SELECT unnest(generate_series(0, 99)) AS j) js ON js.j < m.k GROUP BY 1, 2, 3) d ON d.model = c.model AND d.i = c.i"""
    of = f"SELECT * FROM {gaps} WHERE label IN ('{a}', '{b}')"
    both = did(f"SELECT g.*, w.ws FROM ({of}) g JOIN ({ws}) w ON w.rep = g.rep AND w.model = g.model AND w.seed = g.seed WHERE g.rep > 0", "draw_both")
    units = did(f"SELECT *, 1 AS ws FROM ({of}) WHERE rep > 0", "draw_units")
    seeds = did(f"SELECT w.rep, g.label, g.model, g.seed, g.gap, w.ws FROM ({of}) g JOIN ({ws}) w ON w.model = g.model AND w.seed = g.seed WHERE g.rep = 0", "draw_seeds")
    return f"SELECT * FROM ({both}) JOIN ({units}) USING (rep) JOIN ({seeds}) USING (rep)"


def summary_sql(draws: str, draw: str) -> str:
    return f"""SELECT *, greatest(abs(ci90_lo), abs(ci90_hi)) AS delta_min, n_undefined <= 0.05 * n_draws AS usable
        FROM (SELECT count(*) AS n_draws, count(*) - count({draw}) AS n_undefined, stddev_samp({draw}) AS se,
                     quantile_cont({draw}, 0.025) AS ci95_lo, quantile_cont({draw}, 0.975) AS ci95_hi,
                     quantile_cont({draw}, 0.05) AS ci90_lo, quantile_cont({draw}, 0.95) AS ci90_hi,
                     least(1, greatest(2 * least(count(*) FILTER (WHERE {draw} <= 0) / count({draw}), 1 - count(*) FILTER (WHERE {draw} <= 0) / count({draw})),
                                       1 / count({draw}))) AS p_raw FROM ({draws}))"""


def point_sql(gaps: str, a: str, b: str) -> str:
    return f"""SELECT avg(d) AS point FROM (SELECT model, avg(gap) FILTER (WHERE label = '{a}') - avg(gap) FILTER (WHERE label = '{b}') AS d
        FROM {gaps} WHERE rep = 0 GROUP BY model)"""


VERDICT = """CASE WHEN (ci95_lo > 0 OR ci95_hi < 0) AND abs(point) >= 0.01 AND all_agree AND point > 0 THEN 'meaningful drift asymmetry'
    WHEN (ci95_lo > 0 OR ci95_hi < 0) AND abs(point) >= 0.01 AND all_agree THEN 'meaningful asymmetry in the opposite direction'
    WHEN (ci95_lo > 0 OR ci95_hi < 0) AND ci90_lo > -0.01 AND ci90_hi < 0.01 THEN 'distinguishable but trivial'
    WHEN ci90_lo > -0.01 AND ci90_hi < 0.01 THEN 'practically equivalent' ELSE 'inconclusive' END"""


def offset_actions(patterns: Sequence[str]) -> str:
    return f"""SELECT DISTINCT c.stay_id, t.treatmentoffset / 60e0 AS hours FROM o_treatment t JOIN s_cohort c ON c.stay_id = t.patientunitstayid
        WHERE {any_like('lower(t.treatmentstring)', patterns)} AND t.treatmentoffset BETWEEN 0 AND 5760"""


def pair_sql(abx: str, cul: str) -> str:
    return f"""SELECT a.stay_id, least(a.hours, u.hours) AS suspicion_hours, a.hours AS abx_hours, u.hours AS culture_hours,
            CASE WHEN u.hours >= a.hours THEN 'abx_first' ELSE 'culture_first' END AS "order"
        FROM {abx} a JOIN {cul} u ON u.stay_id = a.stay_id
        WHERE (u.hours - a.hours BETWEEN 0 AND 24) OR (u.hours < a.hours AND a.hours - u.hours <= 72)"""


def lab_names(names: dict) -> str:
    return " ".join("WHEN " + " OR ".join(f"lower(l.labname) LIKE '{x}%'" for x in spec["names"])
                    + f" THEN CASE WHEN l.labresult BETWEEN {spec['valid'][0]} AND {spec['valid'][1]} THEN '{n}' END" for n, spec in names.items())


def vitals_sql(table: str, specs: dict) -> str:
    return " UNION ALL ".join(
        f"""SELECT c.stay_id, '{n}' AS concept, v.observationoffset / 60e0 AS hours, v.{s['column']} AS value FROM {table} v
            JOIN s_cohort c ON c.stay_id = v.patientunitstayid WHERE v.{s['column']} BETWEEN {s['valid'][0]} AND {s['valid'][1]}
            AND v.observationoffset BETWEEN 0 AND 5760""" for n, s in specs.items())


VARIABLES = [*config.VITALS, *config.LABS, *config.DERIVED]
RATES = ["creatinine", "culture", "antibiotic"]
SITE_LIMITS = (20, 0.1, 0.15)

SHARED: dict[str, str] = {
    "lab_map": concept_map(config.LAB_CONCEPTS),
    "chart_map": concept_map(config.CHART_CONCEPTS),
    "cohort": cohort_sql("icustays", "patients", "admissions"),
    "order_cohort": cohort_sql("order_stays", "order_patients", "order_admissions"),
    "followed": f"SELECT stay_id, least(los_hours, {STUDY_HOURS}e0) AS max_hours FROM cohort",
    "labs": f"""SELECT c.stay_id, m.concept, {HOURS.format(t='l.charttime')} AS hours, l.valuenum AS value
        FROM labevents l JOIN lab_map m ON m.itemid = l.itemid JOIN cohort c ON c.hadm_id = l.hadm_id
        WHERE l.valuenum BETWEEN m.lo AND m.hi AND l.charttime BETWEEN c.intime - INTERVAL 7 DAY AND c.intime + INTERVAL {STUDY_HOURS} HOUR""",
    "charts": f"""SELECT c.stay_id, m.concept, {HOURS.format(t='e.charttime')} AS hours, e.valuenum AS value
        FROM chartevents e JOIN chart_map m ON m.itemid = e.itemid JOIN cohort c ON c.stay_id = e.stay_id
        WHERE e.valuenum BETWEEN m.lo AND m.hi AND e.charttime >= c.intime AND e.charttime <= c.intime + INTERVAL {STUDY_HOURS} HOUR""",
    "gcs": f"""SELECT stay_id, hours, eye + verbal + motor AS value FROM (
        SELECT e.stay_id, {HOURS.format(t='e.charttime')} AS hours, e.charttime, max(CASE WHEN e.itemid = 220739 THEN e.valuenum END) AS eye,
               max(CASE WHEN e.itemid = 223900 THEN e.valuenum END) AS verbal, max(CASE WHEN e.itemid = 223901 THEN e.valuenum END) AS motor
        FROM chartevents e JOIN cohort c ON c.stay_id = e.stay_id
        WHERE e.valuenum IS NOT NULL AND e.charttime >= c.intime AND e.charttime <= c.intime + INTERVAL {STUDY_HOURS} HOUR GROUP BY 1, 2, 3)
        WHERE eye IS NOT NULL AND verbal IS NOT NULL AND motor IS NOT NULL""",
    "vent": f"""SELECT DISTINCT e.stay_id, {HOURS.format(t='e.charttime')} AS hours FROM chartevents e JOIN cohort c ON c.stay_id = e.stay_id
        WHERE e.itemid IN ({', '.join(map(str, config.VENTILATION_ITEMS))}) AND (e.valuenum IS NOT NULL OR e.value IS NOT NULL)
        AND e.charttime >= c.intime AND e.charttime <= c.intime + INTERVAL {STUDY_HOURS} HOUR""",
    "urine": f"""SELECT o.stay_id, {HOURS.format(t='o.charttime')} AS hours, sum(CASE WHEN o.itemid = 227488 THEN -o.value ELSE o.value END) AS value
        FROM outputevents o JOIN cohort c ON c.stay_id = o.stay_id WHERE o.value BETWEEN 0 AND 5000
        AND o.charttime >= c.intime AND o.charttime <= c.intime + INTERVAL {STUDY_HOURS} HOUR GROUP BY 1, 2""",
    "weighed": """SELECT c.stay_id, CASE WHEN e.itemid = 226531 THEN e.valuenum * 0.45359237e0 ELSE e.valuenum END AS kg, e.charttime
        FROM chartevents e JOIN cohort c ON c.stay_id = e.stay_id
        WHERE e.itemid IN (226512, 224639, 226531) AND e.valuenum IS NOT NULL AND e.charttime <= c.intime + INTERVAL 48 HOUR""",
    "first_weight": """SELECT stay_id, arg_min(kg, charttime) AS weight_kg FROM weighed GROUP BY stay_id
        HAVING arg_min(kg, charttime) BETWEEN 20 AND 400""",
    "wt": """SELECT c.stay_id, coalesce(w.weight_kg, m.fallback) AS weight_kg, w.weight_kg IS NULL AS weight_imputed
        FROM cohort c LEFT JOIN first_weight w ON w.stay_id = c.stay_id
        LEFT JOIN (SELECT c2.gender, median(w2.weight_kg) AS fallback FROM cohort c2 JOIN first_weight w2 ON w2.stay_id = c2.stay_id GROUP BY 1) m
        ON m.gender = c.gender""",
    "pressors": f"""SELECT stay_id, drug, rate, CAST(unnest(generate_series(greatest(CAST(floor(a) AS BIGINT), 0), least(CAST(ceil(b) AS BIGINT), {STUDY_HOURS}))) AS DOUBLE) AS hours
        FROM (SELECT i.stay_id, CASE i.itemid WHEN 221906 THEN 'norepinephrine' WHEN 221289 THEN 'epinephrine' WHEN 229617 THEN 'epinephrine'
                     WHEN 221662 THEN 'dopamine' WHEN 221653 THEN 'dobutamine' END AS drug,
                     CASE lower(i.rateuom) WHEN 'mcg/kg/min' THEN i.rate WHEN 'mg/kg/min' THEN i.rate * 1000 WHEN 'mcg/min' THEN i.rate / w.weight_kg
                          WHEN 'mg/min' THEN i.rate * 1000 / w.weight_kg WHEN 'mcg/kg/hr' THEN i.rate / 60 WHEN 'mg/kg/hr' THEN i.rate * 1000 / 60 END AS rate,
                     {HOURS.format(t='i.starttime')} AS a, {HOURS.format(t='i.endtime')} AS b
              FROM inputevents i JOIN cohort c ON c.stay_id = i.stay_id LEFT JOIN wt w ON w.stay_id = i.stay_id
              WHERE i.rate > 0 AND i.endtime >= c.intime AND i.starttime <= c.intime + INTERVAL {STUDY_HOURS} HOUR)
        WHERE rate IS NOT NULL AND drug IS NOT NULL""",
    "abx": actions("abx", "true"),
    "cul": actions("cul", NOT_SURVEILLANCE),
    "pairs": pair_sql("abx", "cul"),
    "fractions": """SELECT stay_id, hours, max(f) AS f FROM (SELECT stay_id, hours, CASE WHEN value >= 20 THEN value / 100
        WHEN value BETWEEN 0.2 AND 1.0 THEN value END AS f FROM charts WHERE concept = 'fio2') WHERE f IS NOT NULL GROUP BY 1, 2""",
    "oxygen": """SELECT p.stay_id, p.hours, p.value / coalesce(CASE WHEN round((p.hours - f.hours) * 3600000e0) <= 14400000 THEN f.f END, 0.21e0) AS value
        FROM (SELECT * FROM labs WHERE concept = 'pao2') p ASOF LEFT JOIN fractions f ON f.stay_id = p.stay_id AND p.hours >= f.hours""",
    "score_rows": """SELECT stay_id, 'pf' AS concept, hours, value FROM oxygen
        UNION ALL SELECT stay_id, concept, hours, value FROM labs WHERE concept IN ('platelets', 'bilirubin_total', 'creatinine')
        UNION ALL SELECT stay_id, concept, hours, value FROM charts WHERE concept = 'map'
        UNION ALL SELECT stay_id, 'gcs', hours, value FROM gcs UNION ALL SELECT stay_id, 'ventilated', hours, 1e0 FROM vent
        UNION ALL SELECT stay_id, 'urine', hours, value FROM urine UNION ALL SELECT stay_id, 'rate_' || drug, hours, rate FROM pressors""",
    "sofa": scores_sql("score_rows", "followed"),
    "crea_staged": creatinine_sql("(SELECT * FROM labs WHERE concept = 'creatinine')"),
    "urine_staged": urine_sql("urine", "wt"),
    "on_crea": first_stage("crea_staged"),
    "on_urine": first_stage("urine_staged"),
    "on_sofa": organ_onset("sofa"),
    "on_sepsis": sepsis_onset("sofa", "pairs"),
    "all_onsets": onsets_union({n: f"SELECT * FROM {t}" for n, t in
                               (("aki_creatinine", "on_crea"), ("sofa_dysfunction", "on_sofa"), ("aki_urine", "on_urine"), ("sepsis3", "on_sepsis"))}),
    "common": f"""SELECT stay_id, epoch FROM cohort WHERE stay_id NOT IN (SELECT stay_id FROM on_crea WHERE onset_hours <= {T})
        AND stay_id NOT IN (SELECT stay_id FROM on_urine WHERE onset_hours <= {T})""",
    "labelled": "SELECT c.stay_id, c.epoch, " + ", ".join(
        f"CAST(coalesce(max(CASE WHEN o.label = '{n}' AND o.onset_hours > {T} AND o.onset_hours <= {H} THEN 1 END), 0) AS INTEGER) AS {n}"
        for n in config.LABELS) + " FROM common c LEFT JOIN all_onsets o ON o.stay_id = c.stay_id GROUP BY 1, 2",
    # --- offset clock
    "s_first": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uniquepid ORDER BY hospitaldischargeyear, patienthealthsystemstayid,
        unitvisitnumber, patientunitstayid) AS rk FROM o_patient) WHERE rk = 1""",
    "s_all": """SELECT p.patientunitstayid AS stay_id, p.uniquepid, p.hospitalid, p.unitdischargeoffset, p.gender,
               CASE WHEN p.age = '> 89' THEN 90 ELSE TRY_CAST(p.age AS INTEGER) END AS age, TRY_CAST(p.admissionweight AS DOUBLE) AS weight_kg,
               h.region, h.numbedscategory, h.teachingstatus
        FROM s_first p LEFT JOIN o_hospital h ON h.hospitalid = p.hospitalid
        WHERE p.unitdischargeoffset >= 720 AND CASE WHEN p.age = '> 89' THEN 90 ELSE TRY_CAST(p.age AS INTEGER) END >= 18""",
    "s_sites": f"""SELECT *, included AND frac_culture >= {SITE_LIMITS[2]} AS sepsis_subset FROM (
        SELECT *, n_stays >= {SITE_LIMITS[0]} AND frac_creatinine >= {SITE_LIMITS[1]} AS included FROM (
            SELECT c.hospitalid, any_value(c.region) AS region, any_value(c.numbedscategory) AS beds, any_value(c.teachingstatus) AS teaching,
                   count(*) AS n_stays, avg(CASE WHEN a.s IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac_creatinine,
                   avg(CASE WHEN b.s IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac_culture
            FROM s_all c
            LEFT JOIN (SELECT DISTINCT patientunitstayid AS s FROM o_lab WHERE lower(labname) LIKE 'creatinine%' AND labresult IS NOT NULL
                       AND labresultoffset BETWEEN 0 AND 2880) a ON a.s = c.stay_id
            LEFT JOIN (SELECT DISTINCT patientunitstayid AS s FROM o_treatment WHERE lower(treatmentstring) LIKE '%cultures%') b ON b.s = c.stay_id
            GROUP BY c.hospitalid))""",
    "s_cohort": "SELECT c.*, h.sepsis_subset FROM s_all c JOIN s_sites h ON h.hospitalid = c.hospitalid WHERE h.included",
    "s_labs": f"""SELECT * FROM (SELECT c.stay_id, CASE {lab_names(config.OFFSET_LABS)} END AS concept, l.labresultoffset / 60e0 AS hours, l.labresult AS value
        FROM o_lab l JOIN s_cohort c ON c.stay_id = l.patientunitstayid WHERE l.labresultoffset BETWEEN 0 AND 5760) WHERE concept IS NOT NULL""",
    "s_vitals": vitals_sql("o_periodic", config.OFFSET_PERIODIC) + " UNION ALL " + vitals_sql("o_aperiodic", config.OFFSET_APERIODIC),
    "s_total": """SELECT patientunitstayid AS stay_id, nursingchartoffset AS off, TRY_CAST(nursingchartvalue AS DOUBLE) AS value FROM o_nurse
        WHERE nursingchartcelltypevalname = 'GCS Total' AND nursingchartoffset BETWEEN 0 AND 5760""",
    "s_parts": """SELECT patientunitstayid AS stay_id, nursingchartoffset AS off, sum(TRY_CAST(nursingchartvalue AS DOUBLE)) AS value,
               count(DISTINCT nursingchartcelltypevalname) AS n FROM o_nurse
        WHERE nursingchartcelltypevalname IN ('Eyes', 'Motor', 'Verbal') AND nursingchartoffset BETWEEN 0 AND 5760 GROUP BY 1, 2""",
    "s_gcs": """SELECT m.stay_id, m.off / 60e0 AS hours, m.value FROM (
            SELECT stay_id, off, value FROM s_total UNION ALL
            SELECT p.stay_id, p.off, p.value FROM s_parts p LEFT JOIN (SELECT DISTINCT stay_id, off FROM s_total) t ON t.stay_id = p.stay_id AND t.off = p.off
            WHERE p.n = 3 AND t.stay_id IS NULL) m JOIN s_cohort c ON c.stay_id = m.stay_id WHERE m.value BETWEEN 3 AND 15""",
    "s_urine": """SELECT c.stay_id, i.intakeoutputoffset / 60e0 AS hours, sum(i.cellvaluenumeric) AS value
        FROM o_intake i JOIN s_cohort c ON c.stay_id = i.patientunitstayid
        WHERE (lower(i.celllabel) LIKE '%urine%' OR lower(i.celllabel) LIKE '%foley%' OR lower(i.celllabel) LIKE '%void%')
        AND lower(i.celllabel) NOT LIKE '%irrigant%' AND i.cellvaluenumeric BETWEEN 0 AND 5000 AND i.intakeoutputoffset BETWEEN 0 AND 5760 GROUP BY 1, 2""",
    "s_wt": """SELECT w.stay_id, coalesce(w.weight_kg, m.fallback) AS weight_kg, w.weight_kg IS NULL AS weight_imputed
        FROM (SELECT stay_id, gender, CASE WHEN weight_kg BETWEEN 20 AND 400 THEN weight_kg END AS weight_kg FROM s_cohort) w
        LEFT JOIN (SELECT gender, median(weight_kg) FILTER (WHERE weight_kg BETWEEN 20 AND 400) AS fallback FROM s_cohort GROUP BY 1) m ON m.gender = w.gender""",
    "s_vent": """SELECT DISTINCT c.stay_id, TRY_CAST(r.respchartoffset AS INTEGER) / 60e0 AS hours FROM o_respiratory r
        JOIN s_cohort c ON c.stay_id = r.patientunitstayid WHERE TRY_CAST(r.respchartoffset AS INTEGER) BETWEEN 0 AND 5760""",
    "s_pressors": """SELECT DISTINCT c.stay_id, CASE WHEN lower(i.drugname) LIKE '%norepinephrine%' OR lower(i.drugname) LIKE '%levophed%' THEN 'norepinephrine'
               WHEN lower(i.drugname) LIKE '%epinephrine%' THEN 'epinephrine' WHEN lower(i.drugname) LIKE '%dopamine%' THEN 'dopamine'
               WHEN lower(i.drugname) LIKE '%dobutamine%' THEN 'dobutamine' END AS drug, TRY_CAST(i.infusionoffset AS INTEGER) / 60e0 AS hours
        FROM o_infusion i JOIN s_cohort c ON c.stay_id = i.patientunitstayid
        WHERE TRY_CAST(i.infusionoffset AS INTEGER) BETWEEN 0 AND 5760 AND (lower(i.drugname) LIKE '%norepinephrine%' OR lower(i.drugname) LIKE '%levophed%'
              OR lower(i.drugname) LIKE '%epinephrine%' OR lower(i.drugname) LIKE '%dopamine%' OR lower(i.drugname) LIKE '%dobutamine%')""",
    "s_abx": offset_actions(config.OFFSET_ANTIBIOTIC),
    "s_cul": offset_actions(config.OFFSET_CULTURE),
    "s_pairs": pair_sql("s_abx", "s_cul"),
    "s_rows": """SELECT stay_id, CASE concept WHEN 'pao2' THEN 'pf' ELSE concept END AS concept, hours, CASE concept WHEN 'pao2' THEN value / 0.21e0 ELSE value END AS value
        FROM s_labs WHERE concept IN ('pao2', 'platelets', 'bilirubin_total', 'creatinine')
        UNION ALL SELECT stay_id, concept, hours, value FROM s_vitals WHERE concept = 'map'
        UNION ALL SELECT stay_id, 'gcs', hours, value FROM s_gcs UNION ALL SELECT stay_id, 'ventilated', hours, 1e0 FROM s_vent
        UNION ALL SELECT stay_id, 'urine', hours, value FROM s_urine""",
    "s_followed": "SELECT stay_id, least(unitdischargeoffset / 60e0, 96e0) AS max_hours FROM s_cohort",
    "s_sofa": scores_sql("s_rows", "s_followed"),
    "s_on_crea": first_stage(f"({creatinine_sql('(SELECT * FROM s_labs WHERE concept = ' + chr(39) + 'creatinine' + chr(39) + ')')})"),
    "s_on_urine": first_stage(f"({urine_sql('s_urine', 's_wt')})"),
    "s_on_sofa": organ_onset("s_sofa"),
    "s_on_sepsis": sepsis_onset("s_sofa", "s_pairs"),
    "s_onsets": onsets_union({n: f"SELECT * FROM {t}" for n, t in
                             (("aki_creatinine", "s_on_crea"), ("sofa_dysfunction", "s_on_sofa"), ("aki_urine", "s_on_urine"), ("sepsis3", "s_on_sepsis"))}),
    "s_common": f"""SELECT stay_id, hospitalid, region FROM s_cohort WHERE stay_id NOT IN (SELECT stay_id FROM s_on_crea WHERE onset_hours <= {T})
        AND stay_id NOT IN (SELECT stay_id FROM s_on_urine WHERE onset_hours <= {T})""",
    "s_labelled": "SELECT c.stay_id, c.hospitalid, c.region, " + ", ".join(
        f"CAST(coalesce(max(CASE WHEN o.label = '{n}' AND o.onset_hours > {T} AND o.onset_hours <= {H} THEN 1 END), 0) AS INTEGER) AS {n}"
        for n in config.LABELS) + " FROM s_common c LEFT JOIN s_onsets o ON o.stay_id = c.stay_id GROUP BY 1, 2, 3",
    # --- features
    "feature_rows": """SELECT stay_id, concept AS variable, hours, value FROM charts
            WHERE concept IN ('heart_rate', 'sbp', 'dbp', 'map', 'resp_rate', 'spo2') AND hours < 6
        UNION ALL SELECT stay_id, 'temperature', hours, v FROM (SELECT stay_id, hours, CASE concept WHEN 'temperature_f' THEN (value - 32.0) * 5.0 / 9.0 ELSE value END AS v
            FROM charts WHERE concept IN ('temperature_c', 'temperature_f')) WHERE v BETWEEN 25 AND 45 AND hours < 6
        UNION ALL SELECT stay_id, concept, hours, value FROM labs WHERE hours >= 0 AND hours < 6
        UNION ALL SELECT stay_id, 'gcs_total', hours, value FROM gcs WHERE hours < 6
        UNION ALL SELECT u.stay_id, 'urine_rate', u.hours, u.value / w.weight_kg FROM urine u LEFT JOIN wt w ON w.stay_id = u.stay_id WHERE u.hours < 6""",
    "panel": "SELECT g.stay_id, g.hour, " + ", ".join(
        f"{'sum' if v == 'urine_rate' else 'avg'}(CASE WHEN f.variable = '{v}' THEN f.value END) AS {v}" for v in VARIABLES) + """
        FROM (SELECT stay_id, CAST(unnest(generate_series(0, 5)) AS INTEGER) AS hour FROM common) g
        LEFT JOIN feature_rows f ON f.stay_id = g.stay_id AND floor(f.hours) = g.hour GROUP BY 1, 2""",
    # --- models
    **model_ctes(),
    # --- inference
    "unit_w": poisson_weights_sql("(SELECT doc_id AS unit_id FROM scored)", "unit_id"),
    "half_cdf": HALF_CDF,
    **tree_ctes("exact", "(SELECT doc_id AS unit_id FROM scored)", "unit_id", 11),
    **tree_ctes("source", "(SELECT source AS cluster FROM scored)", "cluster", 4),
    "sourcep_w": poisson_weights_sql("(SELECT DISTINCT source AS cluster FROM scored)", "cluster"),
    **resampled_ctes("unit", "unit_w", "unit_id"),
    **resampled_ctes("exact", "exact_w", "unit_id"),
    **resampled_ctes("source", "source_w", "cluster"),
    **resampled_ctes("sourcep", "sourcep_w", "cluster"),
    "cells": """SELECT *, auroc_oracle - auroc_transferred AS gap, (auroc_oracle - auroc_transferred) / greatest(auroc_oracle - 0.5, 1e-6) AS gap_relative,
            ln(o / (1 - o)) - ln(t / (1 - t)) AS gap_logit
        FROM (SELECT *, least(greatest(auroc_oracle, 1e-6), 1 - 1e-6) AS o, least(greatest(auroc_transferred, 1e-6), 1 - 1e-6) AS t
              FROM (SELECT label, model, seed, max(CASE WHEN kind = 'transferred' THEN auroc END) AS auroc_transferred,
                           max(CASE WHEN kind = 'oracle' THEN auroc END) AS auroc_oracle FROM unit_auroc WHERE rep = 0 GROUP BY 1, 2, 3))""",
    "signs": """SELECT *, (SELECT count(DISTINCT sign(x)) FROM (VALUES (gap), (gap_relative), (gap_logit)) AS t(x) WHERE x <> 0) <= 1 AS all_agree
        FROM (SELECT avg(g) AS gap, avg(r) AS gap_relative, avg(l) AS gap_logit FROM (
            SELECT model, avg(gap) FILTER (WHERE label = 'toxic') - avg(gap) FILTER (WHERE label = 'quality') AS g,
                   avg(gap_relative) FILTER (WHERE label = 'toxic') - avg(gap_relative) FILTER (WHERE label = 'quality') AS r,
                   avg(gap_logit) FILTER (WHERE label = 'toxic') - avg(gap_logit) FILTER (WHERE label = 'quality') AS l FROM cells GROUP BY model))""",
}
