"""SQL for an independent engine, query by query, over the same tables."""

from __future__ import annotations

#: Common table expressions and what each needs.
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "x": ((), "SELECT l_partkey AS feature_id, l_suppkey AS cell_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"),
    "n": ((), "SELECT (SELECT count(*) FROM part)::DOUBLE AS f, (SELECT count(*) FROM supplier)::DOUBLE AS c"),
    "nat": ((), "SELECT s_suppkey AS cell_id, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "reg": ((), "SELECT s_suppkey AS cell_id, r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "cs": (("x",), "SELECT cell_id, sum(value) AS t FROM x GROUP BY 1"),
    "y": (("x", "cs"), "SELECT feature_id, cell_id, ln(1 + (SELECT median(t) FROM cs) * value / t) AS value FROM x JOIN cs USING (cell_id)"),
    "ns": (("y", "nat"), "SELECT feature_id, label AS grp, sum(value) AS value FROM y JOIN nat USING (cell_id) GROUP BY ALL"),
    "brands": ((), "SELECT p_brand AS set_name, p_partkey AS feature_id FROM part"),
    "beta": (("y", "n"), "SELECT cell_id, (count(*) / f) / (sum(count(*) / f) OVER () / c) AS beta FROM y, n GROUP BY cell_id, f, c"),
    "e": ((), "SELECT vec_id AS cell_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings"),
    "p": (("e",), "SELECT cell_id, dim, abs(value) / sum(abs(value)) OVER (PARTITION BY cell_id) AS p FROM e"),
    "jsd": (("p",), "SELECT a.cell_id AS a, b.cell_id AS b, sqrt(greatest(0, 0.5 * sum(CASE WHEN a.p > 0 THEN a.p * log2(a.p / ((a.p + b.p) / 2)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * log2(b.p / ((a.p + b.p) / 2)) ELSE 0 END))) AS distance FROM p a JOIN p b ON a.dim = b.dim AND a.cell_id < b.cell_id GROUP BY 1, 2"),
    "near": (("jsd",), "SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbour) AS rank FROM (SELECT a AS cell_id, b AS neighbour, round(distance, 9) AS distance FROM jsd UNION ALL SELECT b, a, round(distance, 9) FROM jsd)"),
    "run": (("near",), "SELECT *, sum(distance) OVER w AS s, sum(distance * distance) OVER w AS q FROM near WHERE rank <= (SELECT least(count(*) - 1, 5 * round(sqrt(count(*)))) FROM embeddings) WINDOW w AS (PARTITION BY cell_id ORDER BY rank)"),
    "cut": (("run",), "SELECT cell_id, coalesce(min(CASE WHEN (CASE WHEN rank + s * s - rank * q >= 0 THEN (s + sqrt(greatest(0, rank + s * s - rank * q))) / rank ELSE 0 END) < distance THEN rank - 1 END), max(rank)) AS stop FROM run GROUP BY 1"),
    "g": (("run", "cut"), "SELECT neighbour AS src, cell_id AS dst, 1.0 - distance AS weight FROM run JOIN cut USING (cell_id) WHERE rank < stop"),
    "gand": (("g",), "SELECT a.src, a.dst, sqrt(a.weight * b.weight) AS weight FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src"),
    "gin": (("g",), "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM g"),
    "adj": (("gand",), "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM gand WHERE weight > 0"),
    "trans": (("gand",), "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM gand"),
    "lab": ((), "SELECT vec_id AS v, label FROM embeddings"),
    "rgb": ((), "SELECT vec_id AS cell_id, label AS grp, least(1.0, abs(embedding[1]::DOUBLE) * 3) AS r, least(1.0, abs(embedding[2]::DOUBLE) * 3) AS g, least(1.0, abs(embedding[3]::DOUBLE) * 3) AS b FROM embeddings"),
    "lin": (("rgb",), "SELECT cell_id, grp, CASE WHEN r <= 0.0404482362771076 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.0404482362771076 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g, CASE WHEN b <= 0.0404482362771076 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM rgb"),
    "xyz": (("lin",), "SELECT cell_id, grp, (0.4123955889674142161*r + 0.3575834307637148171*g + 0.1804926473817015735*b) / 0.950456 AS x, 0.2125862307855955516*r + 0.7151703037034108499*g + 0.07220049864333622685*b AS y, (0.01929721549174694484*r + 0.1191838645808485318*g + 0.9504971251315797660*b) / 1.088754 AS z FROM lin"),
    "fxyz": (("xyz",), "SELECT cell_id, grp, " + ", ".join(f"CASE WHEN {c} >= pow(6.0/29, 3) THEN pow({c}, 1.0/3) ELSE 841.0/108*{c} + 4.0/29 END AS {c}" for c in "xyz") + " FROM xyz"),
    "lch": (("fxyz",), "SELECT cell_id, grp, 116*y - 16 AS l, 500*(x - y) AS ca, 200*(y - z) AS cb FROM fxyz"),
}


def _bound(obs: str, exp: str, nu: str, a: str, scale: str = " / ln(10.0)") -> str:
    gap = f"(({obs}) - ({exp}))"
    return f"CASE WHEN {gap} > 0 THEN coalesce({gap} * {gap} / nullif(2.0 * (({nu}) + ({a}) * {gap} / 3.0), 0), 0){scale} ELSE 0 END"


def _sql(select: str, *parts: str, **more: str) -> str:
    done: list[str] = []

    def need(name: str) -> None:
        if name not in done:
            for other in _PARTS[name][0]:
                need(other)
            done.append(name)

    for p in parts:
        need(p)
    made = [f"{n} AS ({_PARTS[n][1]})" for n in done] + [f"{n} AS ({t})" for n, t in more.items()]
    return (f"WITH {', '.join(made)} " if made else "") + select


def _specificity(lab: str) -> dict[str, str]:
    return {
        "w": f"SELECT label AS grp, sum(beta) AS s1, sum(beta * beta) AS s2, max(beta) AS a FROM {lab} JOIN beta USING (cell_id) GROUP BY 1",
        "pr": "SELECT feature_id, sum(value) / (SELECT c FROM n) AS pr FROM y GROUP BY 1",
        "obs": f"SELECT feature_id, label AS grp, sum(value) AS o FROM y JOIN {lab} USING (cell_id) GROUP BY ALL",
        "spec": f"SELECT feature_id, grp, coalesce(o, 0) / (SELECT c FROM n) AS profile, {_bound('coalesce(o, 0)', 'pr * s1', 'pr * s2', 'a')} AS significance FROM pr CROSS JOIN w LEFT JOIN obs USING (feature_id, grp)",
    }


def _no_row_scaling(scores: str, sets: str) -> dict[str, str]:
    return {
        "m": f"SELECT grp, sum(value) AS e, sum(value * value) AS v, greatest(max(value), 0) AS a FROM {scores} GROUP BY 1",
        "ps": f"SELECT set_name, count(*) / (SELECT f FROM n) AS ps FROM {sets} GROUP BY 1",
        "hit": f"SELECT set_name, grp, sum(value) AS o FROM {scores} JOIN {sets} USING (feature_id) GROUP BY ALL",
        "enr": f"SELECT set_name, grp, {_bound('coalesce(o, 0)', 'ps * e', 'ps * v', 'a')} AS value FROM ps CROSS JOIN m LEFT JOIN hit USING (set_name, grp)",
    }


def _welch() -> dict[str, str]:
    return {
        "ins": "SELECT dim, label, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM e GROUP BY ALL",
        "tot": "SELECT dim, count(*) AS tn, sum(value) AS ts, sum(value * value) AS tq FROM e GROUP BY ALL",
        "welch": "SELECT dim, label, n, CASE WHEN n < 3 OR tn - n < 3 THEN 0 ELSE coalesce((s / n - (ts - s) / (tn - n)) / nullif(sqrt(greatest(0, (q - s * s / n) / (n - 1) / n + ((tq - q) - (ts - s) * (ts - s) / (tn - n)) / (tn - n - 1) / (tn - n))), 0), 0) END AS t FROM ins JOIN tot USING (dim)",
    }


def _local(p: str, lab: str) -> dict[str, str]:
    return {
        "known": f"SELECT v, label FROM {lab} WHERE label IS NOT NULL",
        "share": "SELECT label, count(*) / (SELECT count(*) FROM known) AS share FROM known GROUP BY 1",
        "facts": f"SELECT src, sum(weight * weight) AS w2, max(weight) AS a FROM {p} GROUP BY 1",
        "seen": f"SELECT src, label, sum(weight) AS o FROM {p} JOIN known ON dst = v GROUP BY ALL",
        "part": "SELECT src, label, o / sum(o) OVER (PARTITION BY src) AS o FROM seen",
        "loc": f"SELECT src AS v, label, {_bound('o', 'share', 'w2 * share', 'a', '')} AS value FROM part JOIN facts USING (src) JOIN share USING (label)",
        "best": "SELECT v, label AS found, value AS top FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY round(value, 9) DESC, label) AS r FROM loc) WHERE r = 1",
    }


def _corr(of: str, over: str, table: str, n: str) -> dict[str, str]:
    return {
        "cm": f"SELECT {of} AS k, sum(value) AS s, sum(value * value) AS q FROM {table} GROUP BY 1",
        "cxy": f"SELECT a.{of} AS a, b.{of} AS b, sum(a.value * b.value) AS xy FROM {table} a JOIN {table} b ON a.{over} = b.{over} AND a.{of} < b.{of} GROUP BY 1, 2",
        "cor": f"SELECT p.k AS a, q.k AS b, coalesce(({n} * coalesce(xy, 0) - p.s * q.s) / nullif(sqrt(({n} * p.q - p.s * p.s) * ({n} * q.q - q.s * q.s)), 0), 0) AS value FROM cm p JOIN cm q ON p.k < q.k LEFT JOIN cxy ON cxy.a = p.k AND cxy.b = q.k",
    }


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


_LABF = "CASE WHEN {0} >= 6.0/29 THEN {0}*{0}*{0} ELSE 108.0/841*({0} - 4.0/29) END"
_GAMMA = "CASE WHEN {0} <= 0.0031306684425005883 THEN 12.92*{0} ELSE 1.055*pow({0}, 1/2.4) - 0.055 END"


def _lab_to_rgb(source: str, keys: str) -> dict[str, str]:
    return {
        "fy": f"SELECT {keys}, (l + 16)/116 AS y, (l + 16)/116 + ca/500 AS x, (l + 16)/116 - cb/200 AS z FROM {source}",
        "wx": f"SELECT {keys}, 0.950456*({_LABF.format('x')}) AS x, {_LABF.format('y')} AS y, 1.088754*({_LABF.format('z')}) AS z FROM fy",
        "raw": f"SELECT {keys}, 3.2406*x - 1.5372*y - 0.4986*z AS r, -0.9689*x + 1.8758*y + 0.0415*z AS g, 0.0557*x - 0.2040*y + 1.0570*z AS b FROM wx",
        "pos": f"SELECT {keys}, r - least(0, r, g, b) AS r, g - least(0, r, g, b) AS g, b - least(0, r, g, b) AS b FROM raw",
        "gam": f"SELECT {keys}, {_GAMMA.format('r')} AS r, {_GAMMA.format('g')} AS g, {_GAMMA.format('b')} AS b FROM pos",
    }


_WIDE = "(SELECT count(*) FROM embeddings)"
_ACC = "SELECT s_suppkey AS cell_id, floor(s_acctbal / 2000)::BIGINT AS label FROM supplier"

ORACLES: dict[str, str] = {
    "coo_counts": _sql("SELECT * FROM x", "x"),
    "prefilter": _sql("SELECT feature_id, cell_id, value FROM left_ WHERE cell_id IN (SELECT cell_id FROM left_ GROUP BY 1 HAVING count(*) > 250)", "x", "n", left_="SELECT * FROM x WHERE feature_id IN (SELECT feature_id FROM x GROUP BY 1 HAVING count(*) > round_even((SELECT c FROM n) * 0.25, 0))"),
    "event_counts": "SELECT event_type AS feature_id, user_id AS cell_id, count(*)::DOUBLE AS value FROM events GROUP BY ALL",
    "binarize": _sql("SELECT feature_id, cell_id, 1.0::DOUBLE AS value FROM x", "x"),
    "threshold": _sql("SELECT * FROM x WHERE value >= 30", "x"),
    "blacklist_filter": "SELECT p_partkey AS part_id, p_name AS feature_id FROM part WHERE NOT regexp_matches(p_name, 'green|^b|1$', 'i')",
    "set_size_filter": _sql("SELECT set_name, feature_id FROM ins WHERE set_name IN (SELECT set_name FROM ins GROUP BY 1 HAVING count(*) BETWEEN 3 AND 45)", ins="SELECT p_brand AS set_name, p_partkey AS feature_id FROM part WHERE p_size <= 25"),
    "signed_markers": "SELECT p_brand AS celltype, p_name AS feature_id, (CASE WHEN p_size % 3 = 0 THEN 1 ELSE -1 END)::INT AS direction FROM part WHERE p_size % 3 < 2",
    "normalize_labels": _sql("SELECT cell_id, dense_rank() OVER (ORDER BY label)::INT AS label, label AS label_name FROM nat", "nat"),
    "recode_labels": "SELECT s_suppkey AS cell_id, dense_rank() OVER (ORDER BY s_nationkey)::INT AS label FROM supplier",
    "convert_feature_ids": _sql("SELECT coalesce(p_name, '') AS feature_id, sum(value) AS value FROM x LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name FROM part WHERE p_size > 10 GROUP BY 1) ON p_partkey = feature_id GROUP BY 1", "x"),
    "supported_archetypes": _sql("SELECT dim::INT AS arch FROM e WHERE value - 0.1 > 0 GROUP BY 1 HAVING count(*) >= 60", "e"),
    "remove_cells": _sql(f"SELECT feature_id AS arch, cell_id, {_r('value / sum(value) OVER (PARTITION BY feature_id)', 10)} AS value FROM x WHERE cell_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey >= 5)", "x"),
    "norm_median_log1p": _sql(f"SELECT feature_id, cell_id, {_r('value')} AS value FROM y", "y"),
    "norm_logcpm": _sql(f"SELECT feature_id, cell_id, {_r('log2(1e6 * value / t + 1)')} AS value FROM x JOIN cs USING (cell_id)", "x", "cs"),
    "norm_median_ratio": _sql(
        f"SELECT feature_id, cell_id, {_r('log2(v / (f / (SELECT avg(f) FROM fac)) + 1)')} AS value FROM ev JOIN fac USING (cell_id)",
        ev="SELECT event_type AS feature_id, user_id AS cell_id, count(*)::DOUBLE AS v FROM events GROUP BY ALL",
        gm="SELECT feature_id, avg(ln(v)) AS g FROM ev GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT user_id) FROM events)",
        fac="SELECT cell_id, exp(median(ln(v) - g)) AS f FROM ev JOIN gm USING (feature_id) GROUP BY 1",
    ),
    "norm_median_ratio_factors": _sql(
        f"SELECT label AS cell_id, {_r('exp(median(ln(value) - g))')} AS factor FROM px JOIN gm USING (feature_id) GROUP BY 1", "x", "reg",
        px="SELECT feature_id, label, sum(value) AS value FROM x JOIN reg USING (cell_id) GROUP BY ALL", gm="SELECT feature_id, avg(ln(value)) AS g FROM px GROUP BY 1 HAVING count(*) = 5",
    ),
    "norm_cluster_factors": _sql(f"SELECT feature_id, cell_id, {_r('log2(value / (t / ml) + 1)')} AS value FROM x JOIN (SELECT cell_id, t, avg(t) OVER (PARTITION BY label) AS ml FROM cs JOIN nat USING (cell_id)) USING (cell_id)", "x", "cs", "nat"),
    "l1_normalize": _sql(f"SELECT feature_id, cell_id, {_r('value / t', 9)} AS value FROM x JOIN cs USING (cell_id)", "x", "cs"),
    "l2_normalize": _sql(f"SELECT feature_id, cell_id, {_r('value / sqrt(sum(value * value) OVER (PARTITION BY cell_id))', 9)} AS value FROM x", "x"),
    "zscore": _sql(f"SELECT cell_id, dim::INT AS dim, {_r('(value - avg(value) OVER w) / stddev_samp(value) OVER w')} AS value FROM e WINDOW w AS (PARTITION BY dim)", "e"),
    "marginals": _sql(f"SELECT feature_id, count(*) AS nnz, {_r('sum(value)')} AS total, {_r('sum(value * value)')} AS squares, {_r('sum(value) / (SELECT c FROM n)')} AS mean, {_r('max(value)')} AS top FROM x GROUP BY 1", "x", "n"),
    "spmm": _sql(f"SELECT feature_id, grp AS label, {_r('value')} AS value FROM ns", "ns"),
    "col_correlation": _sql(f"SELECT a, b, {_r('value')} AS value FROM cor", "x", "n", **_corr("cell_id", "feature_id", "x", "(SELECT f FROM n)")),
    "cross_product": _sql(f"SELECT a.grp AS row, b.grp AS col, {_r('a.t * b.t', 2)} AS value FROM t a CROSS JOIN t b", "ns", t="SELECT grp, sum(value) AS t FROM ns GROUP BY 1"),
    "feature_specificity": _sql(f'SELECT feature_id, grp AS "group", {_r("profile")} AS profile, {_r("significance")} AS significance FROM spec', "y", "n", "nat", "beta", **_specificity("nat")),
    "specificity_pairwise": _sql(
        f'SELECT feature_id, grp AS "group", {_r(_bound("coalesce(o, 0)", "pr * s1", "pr * s2", "a"))} AS up, {_r("CASE WHEN coalesce(o, 0) - pr * s1 > 0 THEN 0 ELSE coalesce(pow(coalesce(o, 0) - pr * s1, 2) / nullif(2.0 * pr * s2, 0), 0) / ln(10.0) END")} AS down FROM pr CROSS JOIN w LEFT JOIN obs USING (feature_id, grp)', "y", "n", "nat",
        yc="SELECT y.* FROM y JOIN supplier ON cell_id = s_suppkey WHERE s_acctbal > 0", yt="SELECT y.* FROM y JOIN supplier ON cell_id = s_suppkey WHERE NOT s_acctbal > 0",
        nc="SELECT count(*) FILTER (s_acctbal > 0) AS c, count(*) FILTER (NOT s_acctbal > 0) AS t FROM supplier",
        pc="SELECT cell_id, count(*) / (SELECT f FROM n) AS pc FROM yc GROUP BY 1", bt="SELECT cell_id, pc / (sum(pc) OVER () / (SELECT c FROM nc)) AS beta FROM pc",
        w="SELECT label AS grp, sum(beta) AS s1, sum(beta * beta) AS s2, max(beta) AS a FROM nat JOIN bt USING (cell_id) GROUP BY 1",
        pr="SELECT feature_id, coalesce(v, 0) AS pr FROM (SELECT DISTINCT feature_id FROM y) LEFT JOIN (SELECT feature_id, sum(value) / (SELECT t FROM nc) AS v FROM yt GROUP BY 1) USING (feature_id)",
        obs="SELECT feature_id, label AS grp, sum(value) AS o FROM yc JOIN nat USING (cell_id) GROUP BY ALL",
    ),
    "top_markers": _sql(f'SELECT grp AS "group", feature_id, r::INT AS rank, {_r("significance")} AS significance FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(significance, 9) DESC, feature_id) AS r FROM spec) WHERE r <= 5', "y", "n", "nat", "beta", **_specificity("nat")),
    "differential_scores": _sql(f'SELECT feature_id, grp AS "group", {_r("significance")} AS significance FROM spec WHERE feature_id IN (SELECT feature_id FROM (SELECT feature_id, row_number() OVER (PARTITION BY grp ORDER BY round(significance, 9) DESC, feature_id) AS r FROM spec) WHERE r <= 3)', "y", "n", "reg", "beta", **_specificity("reg")),
    "chernoff_enrichment": _sql(
        f'SELECT set_name, grp AS "group", {_r(_bound("coalesce(o, 0)", "ps * e", "ps * ps * v", "ps * a"))} AS value FROM ps CROSS JOIN m LEFT JOIN hit USING (set_name, grp)', "ns", "brands", "n",
        ps="SELECT set_name, count(*) / (SELECT f FROM n) AS ps FROM brands GROUP BY 1", pr="SELECT feature_id, count(*) / (SELECT count(*) FROM ps)::DOUBLE AS pr FROM brands GROUP BY 1",
        rho="SELECT sum(pr) / (SELECT f FROM n) AS rho FROM pr",
        m="SELECT grp, sum(pr * value) / (SELECT rho FROM rho) AS e, sum(pr * value * value) / pow((SELECT rho FROM rho), 2) AS v, greatest(max(value), 0) AS a FROM ns JOIN pr USING (feature_id) GROUP BY 1",
        hit="SELECT set_name, grp, sum(value) AS o FROM ns JOIN brands USING (feature_id) GROUP BY ALL",
    ),
    "chernoff_no_row_scaling": _sql(f'SELECT set_name, grp AS "group", {_r("value")} AS value FROM enr', "ns", "brands", "n", **_no_row_scaling("ns", "brands")),
    "geneset_enrichment": _sql(
        f'SELECT set_name, grp AS "group", {_r("value")} AS value FROM enr', "y", "n", "nat", "beta", "brands", **_specificity("nat"), sg="SELECT feature_id, grp, ln(1 + significance) AS value FROM spec",
        ib="SELECT * FROM brands WHERE feature_id IN (SELECT feature_id FROM sg)", fb="SELECT * FROM ib WHERE set_name IN (SELECT set_name FROM ib GROUP BY 1 HAVING count(*) BETWEEN 3 AND 500)", **_no_row_scaling("sg", "fb"),
    ),
    "geneset_enrichment_prefix": _sql(
        f'SELECT set_name, grp AS "group", {_r("coalesce(value, 0)")} AS value FROM (SELECT DISTINCT set_name FROM brands) CROSS JOIN (SELECT DISTINCT grp FROM spec) LEFT JOIN best USING (set_name, grp)', "y", "n", "reg", "beta", "brands", **_specificity("reg"),
        rk="SELECT *, significance AS value, row_number() OVER w AS r FROM spec WINDOW w AS (PARTITION BY grp ORDER BY round(significance, 9) DESC, feature_id)",
        pre="SELECT *, sum(value) OVER w AS c1, sum(value * value) OVER w AS c2 FROM rk WHERE r <= 1000 WINDOW w AS (PARTITION BY grp ORDER BY r)",
        hits="SELECT set_name, grp, c1, c2, sum(value) OVER (PARTITION BY grp, set_name ORDER BY r) AS o FROM pre JOIN brands USING (feature_id)",
        ps="SELECT set_name, count(*) / (SELECT f FROM n) AS ps FROM brands GROUP BY 1", ma="SELECT grp, greatest(max(significance), 0) AS a FROM spec GROUP BY 1",
        best=f"SELECT set_name, grp, max({_bound('o', 'ps * c1', 'ps * c2', 'a')}) AS value FROM hits JOIN ps USING (set_name) JOIN ma USING (grp) GROUP BY ALL",
    ),
    "double_norm": _sql(
        f'SELECT set_name, grp AS "group", {_r("v / max(v) OVER ()")} AS value FROM dn', "ns", "brands", en="SELECT set_name, grp, sum(value) AS value FROM ns JOIN brands USING (feature_id) GROUP BY ALL",
        lg="SELECT set_name, grp, CASE WHEN max(value) OVER () > 100 THEN ln(1 + value) ELSE value END AS value FROM en", dn="SELECT set_name, grp, value / sqrt(sum(value) OVER (PARTITION BY set_name)) / sqrt(sum(value) OVER (PARTITION BY grp)) AS v FROM lg",
    ),
    "log_mean_exp": _sql(f'SELECT grp AS "group", {_r("ln(sum(exp(ln(10.0) * value))) - ln(5.0)")} AS value FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC) AS r FROM enr) WHERE r <= 5 GROUP BY 1', "ns", "brands", "n", **_no_row_scaling("ns", "brands")),
    "participation_ratio": _sql(f"SELECT feature_id, {_r('pow(sum(value * value), 2) / sum(pow(value, 4))')} AS value FROM x GROUP BY 1", "x"),
    "robust_z": _sql(
        f"SELECT cell_id, label, {_r('coalesce((value - med) / nullif(CASE WHEN mad > 0 THEN mad ELSE sd END, 0), 0)')} AS z FROM c JOIN m USING (label)", "reg",
        a="SELECT cell_id, label, s_acctbal AS value FROM reg JOIN supplier ON s_suppkey = cell_id", b="SELECT label, median(value) AS med, stddev_samp(value) AS sd FROM a GROUP BY 1",
        c="SELECT * FROM a JOIN b USING (label)", m="SELECT label, 1.4826 * median(abs(value - med)) AS mad FROM c GROUP BY 1",
    ),
    "label_overlap_hgt": _sql(
        f"SELECT label_a, label_b, n::BIGINT AS n, {_r('CASE WHEN k > q THEN coalesce(nb * (CASE WHEN k > 0 THEN k * ln(k / q) ELSE 0 END + CASE WHEN k < 1 THEN (1 - k) * ln((1 - k) / (1 - q)) ELSE 0 END), 0) ELSE 0 END')} AS value FROM f", "nat",
        b=_ACC, c="SELECT nat.label AS label_a, b.label AS label_b, count(*) AS n FROM nat JOIN b USING (cell_id) GROUP BY ALL",
        na="SELECT label_a, sum(n)::DOUBLE AS na FROM c GROUP BY 1", nb="SELECT label_b, sum(n)::DOUBLE AS nb FROM c GROUP BY 1",
        f="SELECT label_a, label_b, coalesce(n, 0) AS n, nb, coalesce(n, 0) / nb AS k, na / (SELECT sum(n) FROM c)::DOUBLE AS q FROM na CROSS JOIN nb LEFT JOIN c USING (label_a, label_b)",
    ),
    "welch_t_by_label": _sql(f"SELECT dim::INT AS dim, label, n, {_r('t')} AS t FROM welch", "e", **_welch()),
    "harmonic_p_bh": _sql(
        f"SELECT dim, {_r('p')} AS p, {_r('least(1.0, min(p * m / r) OVER (ORDER BY r DESC RANGE UNBOUNDED PRECEDING))')} AS fdr FROM rk", "e", **_welch(),
        hp="SELECT dim::INT AS dim, count(*) / sum(1.0 / greatest(exp(-abs(t)), 1e-300)) AS p FROM welch GROUP BY 1", rk="SELECT dim, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM hp",
    ),
    "phenotype_enrichment_analytic": _sql(
        f"SELECT dim::INT AS arch, {_r('(sum(r * w) - 0.5 * sum(w)) / sqrt(sum(w * w) / 12.0)')} AS z FROM j GROUP BY 1", "e", w="SELECT cell_id, abs(value) AS w FROM e WHERE dim = 20",
        j="SELECT dim, w, row_number() OVER (PARTITION BY dim ORDER BY value, cell_id) / count(*) OVER (PARTITION BY dim)::DOUBLE AS r FROM e JOIN w USING (cell_id)",
    ),
    "marker_z": _sql(
        f'SELECT set_name, grp AS "group", {_r("coalesce((coalesce(o, 0) - mu * k) / nullif(sqrt(greatest(0, (q - nn * mu * mu) / (nn - 1) * (k - k * k / nn))), 0), 0)")} AS z FROM ps CROSS JOIN m LEFT JOIN hit USING (set_name, grp)', "ns", "brands", "n",
        ps="SELECT set_name, count(*)::DOUBLE AS k FROM brands GROUP BY 1", m="SELECT grp, sum(value) / f AS mu, sum(value * value) AS q, f AS nn FROM ns, n GROUP BY grp, f", hit="SELECT set_name, grp, sum(value) AS o FROM ns JOIN brands USING (feature_id) GROUP BY ALL",
    ),
    "jsd_pairs": _sql(f"SELECT a, b, {_r('distance')} AS distance FROM jsd", "jsd"),
    "knn_jsd": _sql(f"SELECT cell_id, neighbour, rank::INT AS rank, {_r('distance')} AS distance FROM near WHERE rank <= 20", "near"),
    "kstar_graph": _sql(f"SELECT src, dst, {_r('weight')} AS weight FROM g", "g"),
    "graph_and": _sql(f"SELECT src, dst, {_r('weight')} AS weight FROM gand", "gand"),
    "graph_or": _sql(f"SELECT src, dst, {_r('sum(weight) / 2.0')} AS weight FROM (SELECT * FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY 1, 2", "g"),
    "graph_asym": _sql(f"SELECT src, dst, {_r('weight', 9)} AS weight FROM gin", "gin"),
    "double_stochastic": _sql(f"SELECT a.src, b.src AS dst, {_r('sum(a.w * b.w)', 9)} AS weight FROM w a JOIN w b ON a.dst = b.dst GROUP BY 1, 2", "trans", w="SELECT src, dst, weight / sqrt(sum(weight) OVER (PARTITION BY dst) + 1e-16) AS w FROM trans"),
    "pagerank_step": _sql(
        f"SELECT coalesce(m.key, b.key) AS key, coalesce(m.v, b.v) AS v, {_r('coalesce(m, 0) + coalesce(b, 0)', 9)} AS value FROM m FULL JOIN b ON m.key = b.key AND m.v = b.v", "adj", "lab",
        x0="SELECT label AS key, v, 1.0 / count(*) OVER (PARTITION BY label) AS x FROM lab", out_="SELECT DISTINCT dst FROM adj",
        lv="SELECT key, sum(x * CASE WHEN dst IS NULL THEN 1.0 ELSE 1.0 - 0.85::DOUBLE END) AS c FROM x0 LEFT JOIN out_ ON v = dst GROUP BY 1",
        m="SELECT key, src AS v, 0.85 * sum(weight * x) AS m FROM x0 JOIN adj ON v = dst GROUP BY ALL", b="SELECT key, v, x * c AS b FROM x0 JOIN lv USING (key)",
    ),
    "impute_step": _sql(
        f"SELECT feature_id, cell_id, {_r('CASE WHEN most > 0 THEN least(top, y * top / most) ELSE 0 END')} AS value FROM y JOIN (SELECT feature_id, max(value) AS top FROM x GROUP BY 1) USING (feature_id) JOIN (SELECT feature_id, max(y) AS most FROM y GROUP BY 1) USING (feature_id)", "adj", "e",
        x="SELECT dim::INT AS feature_id, cell_id, value FROM e WHERE value > 0", x0="SELECT feature_id, cell_id, value / sum(value) OVER (PARTITION BY feature_id) AS x FROM x", out_="SELECT DISTINCT dst FROM adj",
        lv="SELECT feature_id, sum(x * CASE WHEN dst IS NULL THEN 1.0 ELSE 1.0 - 0.85::DOUBLE END) AS c FROM x0 LEFT JOIN out_ ON cell_id = dst GROUP BY 1",
        m="SELECT feature_id, src AS cell_id, 0.85 * sum(weight * x) AS m FROM x0 JOIN adj ON cell_id = dst GROUP BY ALL", b="SELECT feature_id, cell_id, x * c AS b FROM x0 JOIN lv USING (feature_id)",
        y="SELECT coalesce(m.feature_id, b.feature_id) AS feature_id, coalesce(m.cell_id, b.cell_id) AS cell_id, coalesce(m, 0) + coalesce(b, 0) AS y FROM m FULL JOIN b ON m.feature_id = b.feature_id AND m.cell_id = b.cell_id",
    ),
    "sweep_cut": _sql(
        f"SELECT key, v, rank::INT AS rank, {_r('(vol - ins) / least(vol, total - vol)')} AS conductance FROM r WHERE rank >= 5 AND rank < n - 6 AND least(vol, total - vol) > 0", "gand", "e",
        rk="SELECT dim::INT AS key, cell_id AS v, row_number() OVER (PARTITION BY dim ORDER BY round(value, 9) DESC, cell_id) - 1 AS rank FROM e", d="SELECT src AS v, sum(weight) AS d FROM gand GROUP BY 1",
        i="SELECT a.key, greatest(a.rank, b.rank) AS rank, sum(weight) AS w FROM gand JOIN rk a ON src = a.v JOIN rk b ON dst = b.v AND a.key = b.key GROUP BY 1, 2",
        t="SELECT key, v, rank, coalesce(d, 0) AS d, coalesce(w, 0) AS w FROM rk LEFT JOIN d USING (v) LEFT JOIN i USING (key, rank)",
        r="SELECT key, v, rank, sum(d) OVER (PARTITION BY key ORDER BY rank) AS vol, sum(w) OVER (PARTITION BY key ORDER BY rank) AS ins, sum(d) OVER (PARTITION BY key) AS total, count(*) OVER (PARTITION BY key) AS n FROM t",
    ),
    "moran_backbone": _sql(
        f"SELECT a.dim::INT AS a, b.dim::INT AS b, {_r(f'sum(a.z * b.z) / {_WIDE}')} AS value FROM z a JOIN lag_ b ON a.cell_id = b.dst GROUP BY 1, 2", "gin", "e",
        z="SELECT cell_id, dim, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM e WINDOW w AS (PARTITION BY dim)", lag_="SELECT dst, dim, sum(weight * z) AS z FROM gin JOIN z ON src = cell_id GROUP BY ALL",
    ),
    "geary_autocorrelation": _sql(
        f"SELECT key, {_r('c')} AS c, {_r('1 - c / 2')} AS autocorrelation FROM f", "gand", "e", q="SELECT a.dim::INT AS key, sum(weight * (a.value - b.value) * (a.value - b.value)) / 2 AS q FROM gand JOIN e a ON src = a.cell_id JOIN e b ON dst = b.cell_id AND a.dim = b.dim GROUP BY 1",
        s="SELECT dim::INT AS key, count(*) AS n, var_pop(value) AS v FROM e GROUP BY 1", f="SELECT key, (n - 1) * q / (2 * (SELECT sum(weight) FROM gand) * n * v) AS c FROM q JOIN s USING (key)",
    ),
    "categorical_phi_z": _sql(
        f"SELECT {_r('phi', 2)} AS phi, {_r('mean', 2)} AS mean, {_r('z', 4)} AS z, {_r('z * z / 2 / ln(10) - log10(area / sqrt(2 * pi()))', 3)} AS log_p FROM zz, tail", "gand", "lab",
        # f(i, j) for labels a, b; sums over ordered tuples of distinct vertices, label by label
        pl="SELECT label, count(*)::DOUBLE AS c, count(*) / (SELECT count(*) FROM lab)::DOUBLE AS p FROM lab GROUP BY 1", lp="SELECT v, label, p FROM lab JOIN pl USING (label)",
        f="SELECT a.label AS a, b.label AS b, a.c AS ca, b.c - (a.label = b.label)::INT AS cb, CASE WHEN a.label = b.label THEN 1 ELSE -1 END / (a.p * b.p) AS f FROM pl a, pl b",
        r="SELECT a, ca, sum(cb * f) AS r, sum(cb * f * f) AS rr FROM f GROUP BY ALL",
        m="SELECT (SELECT count(*) FROM lab)::DOUBLE AS n, sum(ca * r) AS f1, sum(ca * rr) AS f2, sum(ca * r * r) - sum(ca * rr) AS f3 FROM r",
        s="SELECT sum(weight) AS s0, 2 * sum(weight * weight) AS s1 FROM gand", s2="SELECT sum(d * d) AS s2 FROM (SELECT v, sum(weight) AS d FROM (SELECT src AS v, weight FROM gand UNION ALL SELECT dst, weight FROM gand) GROUP BY 1)",
        ph="SELECT sum(weight * CASE WHEN a.label = b.label THEN 1 ELSE -1 END / (a.p * b.p)) AS phi FROM gand JOIN lp a ON src = a.v JOIN lp b ON dst = b.v",
        mo="SELECT phi, s0 * f1 / (n * (n - 1)) AS mean, s1 * f2 / (n * (n - 1)) + (s2 - 2 * s1) * f3 / (n * (n - 1) * (n - 2)) + (s0 * s0 - s2 + s1) * (f1 * f1 - 4 * f3 - 2 * f2) / (n * (n - 1) * (n - 2) * (n - 3)) AS second FROM m, s, s2, ph",
        zz="SELECT phi, mean, (phi - mean) / sqrt(second - mean * mean) AS z FROM mo",
        tail="SELECT 0.0005 * sum(CASE WHEN i = 0 THEN 0.5 ELSE 1 END * exp(-0.0005 * i * (z + 0.00025 * i))) AS area FROM zz, range(100000) t(i)",
    ),
    "label_local_enrichment": _sql(f"SELECT v, label, {_r('value')} AS value FROM loc", "trans", "lab", **_local("trans", "lab")),
    "infer_missing_step": _sql("SELECT v, coalesce(label, found) AS label FROM lm LEFT JOIN best USING (v)", "trans", "lab", lm="SELECT v, CASE WHEN v % 5 != 0 THEN label END AS label FROM lab", **_local("trans", "lm")),
    "correct_labels_step": _sql(
        "SELECT v, CASE WHEN sw THEN found ELSE label END AS label, sw AS changed FROM (SELECT lab.v, lab.label, found, coalesce(found != lab.label AND log2(greatest(top, 1e-10) / greatest(coalesce(value, 0), 1e-10)) > 0.5, false) AS sw FROM lab LEFT JOIN loc ON lab.v = loc.v AND lab.label = loc.label LEFT JOIN best ON lab.v = best.v)",
        "trans", "lab", **_local("trans", "lab"),
    ),
    "transitivity": _sql(
        f"SELECT k AS v, {_r('coalesce(t, 0) / nullif(s * (d - 1), 0)')} AS value FROM sz LEFT JOIN tr USING (k)", "e", ei="SELECT cell_id, dim::INT AS dim, value FROM e", **_corr("dim", "cell_id", "ei", f"{_WIDE}::DOUBLE"),
        w="SELECT a AS k, b AS i, value AS w FROM cor WHERE value > 0 UNION ALL SELECT b, a, value FROM cor WHERE value > 0", sz="SELECT k, sum(w) AS s, count(*) AS d FROM w GROUP BY 1",
        tr="SELECT x.k, sum((x.w + y.w) / 2) AS t FROM w x JOIN w y ON x.k = y.k AND x.i != y.i JOIN w z ON z.k = x.i AND z.i = y.i GROUP BY 1",
    ),
    "landmark_cells": _sql("SELECT dim::INT AS arch, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY round(value, 9) DESC, cell_id) AS r FROM (SELECT *, max(round(value, 1)) OVER (PARTITION BY dim) AS top FROM e) WHERE round(value, 1) >= top - 1e-6 AND value > 0) WHERE r = 1", "e"),
    "cell_scores_from_enrichment": _sql(
        f"SELECT cell_id, ex.label, {_r('sum(abs(value) * x)')} AS value FROM (SELECT cell_id, dim, value FROM e) JOIN ex USING (dim) GROUP BY ALL", "e",
        m="SELECT dim, label, avg(abs(value)) AS v FROM e GROUP BY ALL", ex="SELECT dim, label, exp(greatest(-3, least(3, (v - avg(v) OVER ()) / stddev_samp(v) OVER ()))) AS x FROM m",
    ),
    "annotation_wide": _sql("SELECT cell_id, nat.label AS nation, reg.label AS region FROM nat JOIN reg USING (cell_id)", "nat", "reg"),
    "set_overlap": _sql(
        f"SELECT set_name, n, {_r('CASE WHEN k > q THEN coalesce(asked * (CASE WHEN k > 0 THEN k * ln(k / q) ELSE 0 END + CASE WHEN k < 1 THEN (1 - k) * ln((1 - k) / (1 - q)) ELSE 0 END), 0) / ln(10.0) ELSE 0 END')} AS value FROM h",
        f="SELECT p_partkey FROM part WHERE p_size <= 20", c="SELECT p_brand AS set_name, count(*) AS size, count(*) FILTER (p_size <= 20) AS n FROM part GROUP BY 1",
        h="SELECT set_name, n, (SELECT count(*) FROM f)::DOUBLE AS asked, n / (SELECT count(*) FROM f)::DOUBLE AS k, size / (SELECT count(*) FROM part)::DOUBLE AS q FROM c WHERE n > 0",
    ),
    "combined_activities": _sql(
        f'SELECT grp AS "group", set_name, {_r("ln(sum(exp(ln(10.0) * value))) - ln(count(*))")} AS value FROM (SELECT * FROM ea UNION ALL SELECT * FROM eb) GROUP BY grp, set_name', "ns", "n",
        sa="SELECT p_type AS set_name, p_partkey AS feature_id FROM part", sb="SELECT p_type AS set_name, p_partkey AS feature_id FROM part WHERE p_size <= 25",
        m=_no_row_scaling("ns", "sa")["m"],
        **{{"ps": "psa", "hit": "hita", "enr": "ea"}[k]: t.replace("FROM ps CROSS", "FROM psa CROSS").replace("JOIN hit ", "JOIN hita ") for k, t in _no_row_scaling("ns", "sa").items() if k != "m"},
        **{{"ps": "psb", "hit": "hitb", "enr": "eb"}[k]: t.replace("FROM ps CROSS", "FROM psb CROSS").replace("JOIN hit ", "JOIN hitb ") for k, t in _no_row_scaling("ns", "sb").items() if k != "m"},
    ),
    "annotate_clusters": _sql(
        f"SELECT cluster, label, 'Cluster ' || cluster || ' (' || label || ')' AS full_name, {_r('value')} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(value, 9) DESC, label) AS r FROM v) WHERE r = 1", "reg",
        b="SELECT s_suppkey AS cell_id, (s_nationkey % 7)::BIGINT AS cluster FROM supplier", c="SELECT label, cluster, count(*) AS n FROM reg JOIN b USING (cell_id) GROUP BY ALL",
        na="SELECT label, sum(n)::DOUBLE AS na FROM c GROUP BY 1", nb="SELECT cluster, sum(n)::DOUBLE AS nb FROM c GROUP BY 1",
        f="SELECT label, cluster, nb, coalesce(n, 0) / nb AS k, na / (SELECT sum(n) FROM c)::DOUBLE AS q FROM na CROSS JOIN nb LEFT JOIN c USING (label, cluster)",
        v="SELECT cluster, label, CASE WHEN k > q THEN coalesce(nb * (CASE WHEN k > 0 THEN k * ln(k / q) ELSE 0 END + CASE WHEN k < 1 THEN (1 - k) * ln((1 - k) / (1 - q)) ELSE 0 END), 0) ELSE 0 END AS value FROM f",
    ),
    "selected_means": _sql(f"SELECT feature_id, label, {_r('sum(value) / any_value(n)')} AS value FROM y JOIN nat USING (cell_id) JOIN (SELECT label, count(*) AS n FROM nat GROUP BY 1) USING (label) WHERE feature_id IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY ALL", "y", "nat"),
    "signature_profile": _sql(f"SELECT e.cell_id AS feature_id, p.label AS arch, {_r('sum(e.value * p.v)')} AS value FROM e JOIN p USING (dim) GROUP BY ALL", "e", p="SELECT label, dim, sum(0.01 * value) AS v FROM e GROUP BY ALL"),
    "rgb_to_lab": _sql(f"SELECT cell_id, {_r('l')} AS l, {_r('ca')} AS a, {_r('cb')} AS b FROM lch", "lch"),
    "lab_to_rgb": _sql(f"SELECT cell_id, {_r('r')} AS r, {_r('g')} AS g, {_r('b')} AS b FROM gam", src_="SELECT vec_id AS cell_id, 50 + 100 * embedding[1]::DOUBLE AS l, 60 * embedding[2]::DOUBLE AS ca, 60 * embedding[3]::DOUBLE AS cb FROM embeddings", **_lab_to_rgb("src_", "cell_id")),
    "color_blend": _sql(f'SELECT grp AS "group", {_r("greatest(0, least(1, r))")} AS r, {_r("greatest(0, least(1, g))")} AS g, {_r("greatest(0, least(1, b))")} AS b FROM gam', "lch", mean_="SELECT grp, avg(l) AS l, avg(ca) AS ca, avg(cb) AS cb FROM lch GROUP BY 1", **_lab_to_rgb("mean_", "grp")),
}
