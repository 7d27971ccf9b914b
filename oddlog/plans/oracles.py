"""The same results as plain SQL on the same tables, for comparison."""

from __future__ import annotations

TOKENS = "[A-Za-z0-9_]{2,}"
EMBEDDED = "e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v FROM embeddings)"


def _share(part: str, text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 0.0 ELSE ({part})::DOUBLE / length({text}) END"


def ratio_parts(text: str) -> dict[str, str]:
    """Everything but entropy."""
    gone = lambda pattern: f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"
    return {
        "alnum": _share(gone(r"[\p{L}\p{N}]"), text),
        "special": _share(rf"length(regexp_replace({text}, '[\p{{L}}\p{{N}}\s\p{{Z}}\x0b\x1c-\x1f]', '', 'g'))", text),
        "illegal": _share(f"length({text}) - length(translate({text}, '<>|{{}}~^`[]', ''))", text),
        "encoded": _share(gone("%[0-9a-fA-F]{2}"), text),
        "vowel": _share(gone("[aeiouAEIOU]"), text),
        "consonant": _share(f"({gone(r'\p{L}')}) - ({gone('[aeiouAEIOU]')})", text),
    }


def entropies(table: str, key: str, text: str) -> str:
    return f"""SELECT {key}, -sum(c / n * log2(c / n)) AS entropy FROM (
        SELECT {key}, ch, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY {key})::DOUBLE AS n
        FROM (SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {table}) GROUP BY {key}, ch) GROUP BY {key}"""


def ratios(table: str, key: str, text: str) -> str:
    parts = ratio_parts(f"t.{text}")
    listed = ", ".join(f"{sql} AS {name}" for name, sql in parts.items())
    return f"""SELECT t.{key}, {listed}, coalesce(h.entropy, 0.0) AS entropy
        FROM {table} t LEFT JOIN ({entropies(table, key, text)}) h USING ({key})"""


RATIOS = ("alnum", "special", "illegal", "encoded", "entropy", "vowel", "consonant")


def rounded_ratios(table: str, key: str, text: str) -> str:
    cells = ", ".join(f"round({n}, 6) AS {n}" for n in RATIOS)
    return f"SELECT {key}, {cells} FROM ({ratios(table, key, text)})"


def term_table(table: str, key: str, tokens: str) -> str:
    return f"""docs AS (SELECT {key} AS k, {tokens} AS ts FROM {table}),
    counts AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM docs) GROUP BY k, term),
    stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY term)"""


def vocab_ctes(table: str, key: str, tokens: str, keep: int, most: str | None = "0.7", least: int = 1) -> str:
    top = f"AND df <= round_even((SELECT count(*) FROM docs) * {most}, 0)" if most else ""
    return f"""{term_table(table, key, tokens)},
    kept AS (SELECT * FROM stats WHERE df >= {least} {top} ORDER BY tf DESC, term LIMIT {keep}),
    vocab AS (SELECT (row_number() OVER (ORDER BY term) - 1)::INT AS idx, term, tf, df FROM kept)"""


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKENS}')"


URL_VOCAB = vocab_ctes("pages", "page_id", words("url"), 1000)


def tfidf(norm: str) -> str:
    size = {"none": "1.0", "l1": "sum(w) OVER (PARTITION BY k)", "l2": "sqrt(sum(w * w) OVER (PARTITION BY k))"}[norm]
    return f"""WITH {URL_VOCAB},
    weighted AS (SELECT k, term, c.tf * (ln((1 + (SELECT count(*) FROM docs))::DOUBLE / (1 + v.df)) + 1) AS w
                 FROM counts c JOIN vocab v USING (term))
    SELECT k AS page_id, term, round(w / {size}, 6) AS value FROM weighted"""


def ecod(rows: str, features: list[str], per_feature: bool = False) -> str:
    """Tail sums from ``rows``, a query with row_id and the features."""
    left, right = "-ln(le / n)", "-ln(ge / n)"
    pick = f"CASE WHEN m3 < 0 THEN {left} ELSE {right} END"
    score = f"sum(greatest({left}, {right}))" if per_feature else f"greatest(sum({left}), sum({right}), sum({pick}))"
    return f"""SELECT row_id, {score} AS score FROM (
        SELECT *, sum((v - mu) ** 3) OVER (PARTITION BY j) AS m3 FROM (
            SELECT *, count(*) OVER (PARTITION BY j)::DOUBLE AS n, avg(v) OVER (PARTITION BY j) AS mu,
                count(*) OVER (PARTITION BY j ORDER BY v RANGE UNBOUNDED PRECEDING)::DOUBLE AS le,
                count(*) OVER (PARTITION BY j ORDER BY v DESC RANGE UNBOUNDED PRECEDING)::DOUBLE AS ge
            FROM (SELECT row_id, unnest([{', '.join(f + '::DOUBLE' for f in features)}]) AS v,
                         unnest(range({len(features)})) AS j FROM ({rows})))) GROUP BY row_id"""


TERM_ECOD = f"""WITH {vocab_ctes('documents', 'doc_id', words('text'), 300)},
    x AS (SELECT k AS row_id, idx AS j, coalesce(c.tf, 0)::DOUBLE AS v FROM docs CROSS JOIN vocab LEFT JOIN counts c USING (k, term)),
    y AS (SELECT *, count(*) OVER (PARTITION BY j)::DOUBLE AS n, avg(v) OVER (PARTITION BY j) AS mu,
        count(*) OVER (PARTITION BY j ORDER BY v RANGE UNBOUNDED PRECEDING)::DOUBLE AS le,
        count(*) OVER (PARTITION BY j ORDER BY v DESC RANGE UNBOUNDED PRECEDING)::DOUBLE AS ge FROM x),
    z AS (SELECT *, sum((v - mu) ** 3) OVER (PARTITION BY j) AS m3 FROM y)
    SELECT row_id, round(greatest(sum(-ln(le / n)), sum(-ln(ge / n)), sum(CASE WHEN m3 < 0 THEN -ln(le / n) ELSE -ln(ge / n) END)), 6) AS score
    FROM z GROUP BY row_id"""

URL_ROWS = f"SELECT page_id AS row_id, * EXCLUDE (page_id) FROM ({ratios('pages', 'page_id', 'url')})"
URL_FLOATS = f"SELECT row_id, {', '.join(f'{n}::FLOAT AS {n}' for n in RATIOS)} FROM ({URL_ROWS})"
URL_ECOD = ecod(URL_FLOATS, list(RATIOS))


def nearest(k: int, include_self: bool = False) -> str:
    keep = "" if include_self else "WHERE a.row_id <> b.row_id"
    return f"""{EMBEDDED},
    g AS (SELECT * FROM (SELECT a.row_id, b.row_id AS nbr_id, list_distance(a.v, b.v) AS dist,
            row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rank
          FROM e a, e b {keep}) WHERE rank <= {k})"""


ORDERED = "p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events), t AS (SELECT count(*) AS n FROM events)"


def in_windows(size: int, step: int, source: str = "p", total: str = "t") -> str:
    return f"""w AS (SELECT win_id, {source}.* FROM {source}, (SELECT unnest(range(
        CASE WHEN n < {size} THEN 0 ELSE (n - {size}) // {step} + 1 END)) AS win_id FROM {total}) s
        WHERE pos BETWEEN win_id * {step} AND win_id * {step} + {size - 1})"""


def windowed(size: int, step: int, reduce: str) -> str:
    return f"WITH {ORDERED}, {in_windows(size, step)} SELECT win_id, round({reduce}(value), 6) AS value FROM w GROUP BY win_id"


MEASURES = """count(*) AS n_samples, sum(hit)::BIGINT AS n_anomalies,
    round(avg((hit = y)::INT), 4) AS accuracy,
    round(coalesce(sum(hit * y) / nullif(sum(hit), 0), 0), 4) AS "precision",
    round(coalesce(sum(hit * y) / nullif(sum(y), 0), 0), 4) AS recall,
    round(coalesce(2 * sum(hit * y) / nullif(sum(hit) + sum(y), 0), 0), 4) AS f1_score,
    sum((1 - hit) * (1 - y))::BIGINT AS confusion_matrix_true_negatives,
    sum(hit * (1 - y))::BIGINT AS confusion_matrix_false_positives,
    sum((1 - hit) * y)::BIGINT AS confusion_matrix_false_negatives,
    sum(hit * y)::BIGINT AS confusion_matrix_true_positives"""

LABELLED = "(SELECT d.*, l.toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
HITS = """(SELECT event_id::VARCHAR AS _id, event_type, value, user_id, CAST(props->>'k' AS INT) AS k, ts FROM events
    WHERE event_type = 'error' AND ts BETWEEN '2024-01-05 00:00:00' AND '2024-01-20 23:59:59.999'
      AND NOT coalesce(CAST(props->>'k' AS INT) >= 90, false))"""
SHAPE = "[length(token) / 7.31::DOUBLE, unicode(token[1:1]) / 7.31::DOUBLE, unicode(token[-1:]) / 7.31::DOUBLE]"
GRAMS = "list_distinct(flatten([[('<' || token || '>')[i:i + n - 1] for i in range(1, length(token) + 4 - n)] for n in range(3, 7)]))"
EVENT_HITS = "(SELECT event_id::VARCHAR AS _id, event_type, value, user_id, CAST(props->>'k' AS INT) AS k FROM events)"


def _part_axis(centred: bool) -> str:
    """First axis (v1, v2) of the two part columns: the closed form of a 2 x 2 eigenproblem, largest loading positive."""
    mean = "avg(x) OVER ()" if centred else "0.0"
    mean_y = "avg(y) OVER ()" if centred else "0.0"
    return f"""raw AS (SELECT p_partkey AS row_id, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part),
        c AS (SELECT row_id, x - {mean} AS x, y - {mean_y} AS y FROM raw),
        g AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM c),
        e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM g),
        u AS (SELECT b / sqrt(b * b + (l - a) ** 2) AS v1, (l - a) / sqrt(b * b + (l - a) ** 2) AS v2 FROM e),
        axis AS (SELECT v1 * s AS v1, v2 * s AS v2 FROM (SELECT *, CASE WHEN abs(v1) > abs(v2) THEN sign(v1) ELSE sign(v2) END AS s FROM u))"""


FAR = "SELECT p_partkey AS row_id FROM part WHERE p_partkey % 500 = 0"
FOLDS = """d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, n_chars::DOUBLE AS v,
        CASE WHEN toxic::VARCHAR = '0' THEN 0 ELSE 1 END AS y FROM """ + LABELLED + """),
    s AS (SELECT count(*) AS n, count(*) // 3 AS q, count(*) % 3 AS r FROM d),
    f AS (SELECT d.*, CASE WHEN row_id < (q + 1) * r THEN row_id // (q + 1)
                           ELSE r + (row_id - (q + 1) * r) // q END AS fold FROM d, s)"""


def one_tail(rows: str, by: str = "") -> str:
    """Tail score of a single feature ``v``, within ``by``."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT * EXCLUDE (le, ge, n, mu, m3), greatest(-ln(le / n), -ln(ge / n)) AS score FROM (
        SELECT *, 0 AS m3 FROM (SELECT *, count(*) OVER ({part})::DOUBLE AS n, 0 AS mu,
            count(*) OVER ({part} ORDER BY v RANGE UNBOUNDED PRECEDING)::DOUBLE AS le,
            count(*) OVER ({part} ORDER BY v DESC RANGE UNBOUNDED PRECEDING)::DOUBLE AS ge FROM ({rows})))"""


def window_ecod(size: int, step: int, extra: str = "") -> str:
    return f"""{ORDERED}, {in_windows(size, step)},
    m AS (SELECT win_id, avg(value) AS v {extra} FROM w GROUP BY win_id),
    z AS ({one_tail('SELECT * FROM m')})"""


TEXT_FLOATS = ", ".join(f"{n}::FLOAT AS {n}" for n in RATIOS)
POINT_ROWS = f"SELECT doc_id AS row_id, {TEXT_FLOATS}, 0.0 AS meaning FROM ({ratios('documents', 'doc_id', 'text')})"

ORACLES: dict[str, str] = {
    "url_ratios": rounded_ratios("pages", "page_id", "url"),
    "lower_ratios": rounded_ratios("(SELECT doc_id, lower(text) AS text FROM documents)", "doc_id", "text"),
    "document_ratios": rounded_ratios("documents", "doc_id", "text"),
    "text_entropy": f"""SELECT conv_id, turn, round(coalesce(entropy, 0.0), 6) AS entropy FROM conversations LEFT JOIN (
        {entropies('conversations', 'conv_id, turn', 'text')}) USING (conv_id, turn)""",
    "meaning_ratio": r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w FROM benchmark),
        pat AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS p FROM words)
        SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE
            (length(text) - length(regexp_replace(lower(text), (SELECT p FROM pat), '', 'g')))::DOUBLE / length(text) END, 6) AS meaning
        FROM documents""",
    "hit_flatten_filter": f"""SELECT event_type AS "event.type", value AS "event.value", user_id AS "user.id", k AS "props.k",
        _id, 'events' AS _index FROM {HITS}""",
    "hit_text_match": r"""SELECT conv_id || '-' || turn AS _id, role FROM conversations
        WHERE NOT list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['thion', 'stion', 'the'])""",
    "hit_max_docs": f"SELECT _id, k FROM {HITS} ORDER BY _id LIMIT 100",
    "label_binarise": f"""SELECT doc_id, coalesce(quality, 0)::INT AS quality,
        CASE WHEN toxic::VARCHAR = '0' THEN 0 ELSE 1 END AS y FROM {LABELLED}""",
    "finite_values": """SELECT l_orderkey, round(max(coalesce(l_extendedprice / nullif(l_discount, 0), 0.0)), 6) AS share,
        count(*) AS n FROM lineitem GROUP BY l_orderkey""",
    "vocab_word": f"WITH {vocab_ctes('documents', 'doc_id', words('text'), 1000)} SELECT * FROM vocab",
    "vocab_char2": f"""WITH {vocab_ctes('pages', 'page_id', "[url[i:i + 1] for i in range(1, length(url))]", 1000)} SELECT * FROM vocab""",
    "vocab_ngrams": f"""WITH c AS (SELECT conv_id || '-' || turn AS id, {words('lower(text)')} AS ts FROM conversations),
        {vocab_ctes('c', 'id', "list_concat(ts, [ts[i] || ' ' || ts[i + 1] for i in range(1, len(ts))])", 2000, None, 2)} SELECT * FROM vocab""",
    "count_terms": f"WITH {URL_VOCAB} SELECT k AS page_id, idx, c.tf FROM counts c JOIN vocab USING (term)",
    "tfidf_l1": tfidf("l1"),
    "tfidf_l2": tfidf("l2"),
    "tfidf_none": tfidf("none"),
    "wide_tfidf": f"WITH {URL_VOCAB} SELECT page_id, idx, value FROM ({tfidf('l2')}) JOIN vocab USING (term)",
    "tfidf_sublinear": f"""WITH {URL_VOCAB}, weighted AS (SELECT k, term,
            (1 + ln(c.tf)) * (ln((SELECT count(*) FROM docs)::DOUBLE / v.df) + 1) AS w FROM counts c JOIN vocab v USING (term))
        SELECT k AS page_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 6) AS value FROM weighted""",
    "hash_tf": f"SELECT page_id, len({words('url')}) AS n_tokens FROM pages WHERE len({words('url')}) > 0",
    "minmax_scale": """SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size,
        round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part""",
    "doc_pool": f"""WITH x AS (SELECT doc_id, unnest({words('text')}) AS token FROM documents),
        m AS (SELECT doc_id, {', '.join(f'avg(({SHAPE})[{i + 1}]) AS v{i}' for i in range(3))} FROM x WHERE length(token) >= 4 GROUP BY doc_id)
        SELECT doc_id, {', '.join(f'round(coalesce(v{i}, 0.0), 6) AS v{i}' for i in range(3))} FROM documents LEFT JOIN m USING (doc_id)""",
    "subword_vectors": f"""WITH known AS (SELECT token, {SHAPE} AS v FROM (
            SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]{{3,}}')) AS token FROM benchmark)),
        grams AS (SELECT gram, {', '.join(f'avg(v[{i + 1}]) AS v{i}' for i in range(3))} FROM (
            SELECT unnest({GRAMS}) AS gram, v FROM known) GROUP BY gram),
        asked AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]{{3,}}')) AS token FROM documents),
        built AS (SELECT token, {', '.join(f'avg(v{i}) AS v{i}' for i in range(3))} FROM (
            SELECT token, unnest({GRAMS}) AS gram FROM asked ANTI JOIN known USING (token)) JOIN grams USING (gram) GROUP BY token)
        SELECT token, {', '.join(f'round(v{i}, 6) AS v{i}' for i in range(3))} FROM (
            SELECT token, {', '.join(f'v[{i + 1}] AS v{i}' for i in range(3))} FROM known SEMI JOIN asked USING (token)
            UNION ALL SELECT * FROM built)""",
    "feature_concat": " UNION ALL ".join(
        f"SELECT page_id, {at + i} AS feature_id, round({n}::FLOAT::DOUBLE, 4) AS value FROM ({ratios('pages', 'page_id', c)}) WHERE {n} <> 0"
        for at, c in ((0, "url"), (8, "html")) for i, n in enumerate(RATIOS)
    ),
    "event_positions": f"WITH {ORDERED} SELECT event_id, pos FROM p",
    "win_mean": windowed(80, 80, "avg"),
    "win_sum_sliding": windowed(80, 20, "sum"),
    "win_sum_dense": windowed(80, 1, "sum"),
    "user_positions": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events",
    "win_users": """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
        w AS (SELECT user_id, value, unnest(range(greatest(0, ceil((pos - 9) / 4)::BIGINT), pos // 4 + 1)) AS win_id FROM p)
        SELECT user_id, win_id, round(avg(value), 6) AS value FROM w GROUP BY user_id, win_id HAVING count(*) = 10""",
    "win_features": f"""WITH r AS ({ratios('documents', 'doc_id', 'text')}),
        p AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM r), t AS (SELECT count(*) AS n FROM r), {in_windows(10, 5)}
        SELECT win_id, round(avg(alnum), 6) AS alnum, round(avg(entropy), 6) AS entropy FROM w GROUP BY win_id""",
    "win_label_max": f"""WITH {ORDERED}, {in_windows(5, 5)} SELECT win_id, max((event_type = 'error')::INT) AS y,
        CASE WHEN bool_or(event_type = 'error') THEN 'Anomaly' ELSE 'ok' END AS truth FROM w GROUP BY win_id""",
    "win_expand": f"""WITH {ORDERED}, {in_windows(20, 10)}, m AS (SELECT win_id, avg(value) AS v FROM w GROUP BY win_id),
        h AS (SELECT win_id FROM m WHERE round(v, 9) > round((SELECT quantile_cont(v, 0.9) FROM m), 9))
        SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM w SEMI JOIN h USING (win_id) WHERE w.event_id = p.event_id) THEN -1 ELSE 0 END AS row_flag FROM p""",
    "ecod_orders": f"SELECT row_id, round(score, 6) AS score FROM ({ecod('SELECT o_orderkey AS row_id, o_totalprice FROM orders', ['o_totalprice'])})",
    "ecod_parts": "SELECT row_id, round(score, 6) AS score FROM (" + ecod(
        "SELECT p_partkey AS row_id, p_size, length(p_name) AS a, length(p_type) AS b FROM part", ["p_size", "a", "b"]) + ")",
    "ecod_urls": f"SELECT row_id, round(score, 6) AS score FROM ({URL_ECOD})",
    "ecod_per_feature": f"SELECT row_id, round(score, 6) AS score FROM ({ecod(URL_FLOATS, list(RATIOS), True)})",
    "ecod_terms": TERM_ECOD,
    "wide_ecod": TERM_ECOD,
    "knn_graph": f"WITH {nearest(5)} SELECT row_id, rank, nbr_id, round(dist, 6) AS dist FROM g",
    "knn_scores": f"""WITH {nearest(5)} SELECT row_id, round(max(dist), 6) AS largest, round(avg(dist), 6) AS mean,
        round(median(dist), 6) AS median FROM g GROUP BY row_id""",
    "lof_scores": f"""WITH {nearest(10)}, kd AS (SELECT row_id, max(dist) AS kd FROM g GROUP BY row_id),
        lrd AS (SELECT g.row_id, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM g JOIN kd ON kd.row_id = g.nbr_id GROUP BY g.row_id)
        SELECT g.row_id, round(avg(o.lrd) / any_value(l.lrd), 6) AS score FROM g JOIN lrd o ON o.row_id = g.nbr_id
        JOIN lrd l ON l.row_id = g.row_id GROUP BY g.row_id""",
    "score_transfer": f"""WITH {nearest(6, True)}, s AS (SELECT row_id, max(dist) AS score FROM g GROUP BY row_id)
        SELECT g.row_id, round(sum(score / (dist + 1e-10)) / sum(1 / (dist + 1e-10)), 6) AS score
        FROM g JOIN s ON s.row_id = g.nbr_id WHERE rank <= 5 GROUP BY g.row_id""",
    "density_scores": f"""WITH RECURSIVE {nearest(5, True)}, core AS (SELECT row_id, max(dist) AS core FROM g GROUP BY row_id),
        dense AS (SELECT e.row_id, v, core FROM e JOIN core USING (row_id) WHERE core <= 1.18),
        near AS (SELECT a.row_id AS a, b.row_id AS b FROM dense a, dense b WHERE list_distance(a.v, b.v) <= 1.18),
        reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
        member AS (SELECT a AS row_id, min(b) AS root FROM reach GROUP BY a),
        grp AS (SELECT root, count(*) AS size, min(core) AS least FROM member JOIN core USING (row_id) GROUP BY root)
        SELECT row_id, round(CASE WHEN size >= 5 THEN 1 - least / core ELSE 1.0 END, 6) AS score
        FROM core LEFT JOIN member USING (row_id) LEFT JOIN grp USING (root)""",
    "density_tree": f"""WITH RECURSIVE {nearest(5, True)}, core AS (SELECT row_id, max(dist) AS core FROM g GROUP BY row_id),
        w AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, greatest(list_distance(a.v, b.v), ca.core, cb.core) AS w
            FROM e a JOIN core ca ON ca.row_id = a.row_id, e b JOIN core cb ON cb.row_id = b.row_id),
        grown AS (SELECT 0 AS step, row_id, CASE WHEN row_id = (SELECT min(row_id) FROM e) THEN 0.0 ELSE 1e300 END AS way FROM e
            UNION ALL SELECT step + 1, p.row_id, least(way, w)
            FROM (SELECT *, first_value(row_id) OVER (ORDER BY way, row_id) AS pick FROM grown) p JOIN w ON a = pick AND b = p.row_id
            WHERE p.row_id <> pick),
        added AS (SELECT min(way) AS w FROM grown WHERE step > 0 GROUP BY step)
        SELECT round(w, 6) AS weight, count(*) AS edges FROM added GROUP BY round(w, 6)""",
    "contamination_labels": f"""WITH s AS (SELECT row_id, round(score, 9) AS score FROM ({URL_ECOD})),
        c AS (SELECT c::VARCHAR AS variant, (SELECT quantile_cont(score, 0.9) FROM s) AS cut FROM (VALUES (0.1)) t(c)
              UNION ALL SELECT '0.2', quantile_cont(score, 0.8) FROM s UNION ALL SELECT '0.3', quantile_cont(score, 0.7) FROM s)
        SELECT row_id, variant, CASE WHEN score > cut THEN -1 ELSE 1 END AS label FROM s, c""",
    "threshold_cuts": """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b,
            avg(value) + 3 * stddev_pop(value) AS z FROM events)
        SELECT round(b + 1.5 * (b - a), 6) AS iqr,
            round(m + 3 * 1.4826 * (SELECT quantile_cont(abs(value - m), 0.5) FROM events), 6) AS mad, round(z, 6) AS zscore FROM q""",
    "exact_quantiles": " UNION ALL ".join(
        f"SELECT {s}::DOUBLE AS share, round(quantile_cont(l_extendedprice, {s}), 6) AS value FROM lineitem" for s in (0.01, 0.5, 0.9, 0.999)),
    "bench_point": f"""WITH s AS ({ecod(POINT_ROWS, [*RATIOS, 'meaning'])}),
        j AS (SELECT score, (score > (SELECT quantile_cont(score, 0.9) FROM s))::INT AS hit,
            CASE WHEN toxic::VARCHAR = '0' THEN 0 ELSE 1 END AS y FROM s JOIN {LABELLED} l ON l.doc_id = s.row_id)
        SELECT 'ratio__text__RatiosWrapper__ecod' AS name, {MEASURES}, round(avg(score), 6) AS score_mean,
            round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM j""",
    "bench_sequence": f"""WITH {window_ecod(8, 8, ", max((event_type = 'error')::INT) AS y")},
        j AS (SELECT y, (score > (SELECT quantile_cont(score, 0.9) FROM z))::INT AS hit FROM z)
        SELECT {MEASURES}, 8 * sum(hit)::BIGINT AS n_row_anomalies FROM j""",
    "vote_point": f"""WITH {nearest(5)}, s AS (SELECT row_id, max(dist) FILTER (rank <= 3) AS a, max(dist) AS b FROM g GROUP BY row_id),
        q AS (SELECT quantile_cont(a, 0.9) AS a1, quantile_cont(a, 0.8) AS a2, quantile_cont(b, 0.9) AS b1, quantile_cont(b, 0.8) AS b2 FROM s)
        SELECT row_id, CASE WHEN (a > a1)::INT + (a > a2)::INT + (b > b1)::INT + (b > b2)::INT >= 2 THEN -1 ELSE 1 END AS label FROM s, q""",
    "vote_sequence": f"""WITH {window_ecod(8, 8)},
        q AS (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score, 0.8) AS b, quantile_cont(score, 0.7) AS c FROM z),
        h AS (SELECT win_id FROM z, q WHERE (score > a)::INT + (score > b)::INT + (score > c)::INT >= 1.5)
        SELECT DISTINCT pos AS row_id FROM w SEMI JOIN h USING (win_id)""",
    "grid_search": f"""WITH {FOLDS}, full_score AS ({one_tail('SELECT row_id, fold, y, v FROM f')}),
        trains AS (SELECT k, f.* FROM f, (SELECT unnest(range(3)) AS k) x WHERE fold <> k),
        train_score AS ({one_tail('SELECT * FROM trains', 'k')}),
        cuts AS (SELECT k, unnest(range(3)) AS setting, unnest([quantile_cont(score, 0.9), quantile_cont(score, 0.8), quantile_cont(score, 0.7)]) AS cut
                 FROM train_score GROUP BY k),
        recalls AS (SELECT setting, k, coalesce(sum((score > cut)::INT * y) / nullif(sum(y), 0), 0.0) AS recall
                    FROM full_score JOIN cuts ON k = fold GROUP BY setting, k),
        means AS (SELECT setting::INT AS setting, avg(recall) AS m, stddev_pop(recall) AS s FROM recalls GROUP BY setting)
        SELECT setting, round(m, 6) AS mean_test_score, round(s, 6) AS std_test_score,
            rank() OVER (ORDER BY m DESC)::INT AS rank_test_score FROM means""",
    "sink_roundtrip": "SELECT event_id::VARCHAR AS event_id, event_type, value::DECIMAL(20, 4)::VARCHAR AS value, props FROM events",
    "csv_text_roundtrip": "SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents",
    "hit_should": f"""SELECT _id FROM {EVENT_HITS} WHERE coalesce((event_type = 'error')::INT, 0) + coalesce((value > 150)::INT, 0)
        + coalesce((k = 7)::INT, 0) >= 2""",
    "hit_terms_exists": f"SELECT _id FROM {EVENT_HITS} WHERE k IN (1, 2, 3) AND user_id IS NOT NULL AND event_type NOT LIKE 'cl%'",
    "hit_missing_field": f"SELECT _id FROM {EVENT_HITS} WHERE event_type LIKE '%r%'",
    "hit_json_scan": f"""SELECT event_type AS "event.type", value AS "event.value", user_id AS "user.id", k AS "props.k",
        _id, 'events' AS _index FROM {HITS}""",
    "pca_part": f"WITH {_part_axis(True)} SELECT row_id, round(x * v1 + y * v2, 4) AS value FROM c, axis",
    "svd_part": f"WITH {_part_axis(False)} SELECT row_id, round(x * v1 + y * v2, 4) AS value FROM c, axis",
    "recon_part": f"WITH {_part_axis(True)} SELECT row_id, round(abs(y * v1 - x * v2), 3) AS score FROM c, axis",
    "pca_norms": """WITH v AS (SELECT vec_id AS row_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        SELECT row_id, round(sqrt(sum(d * d)), 6) AS norm FROM (SELECT row_id, x - avg(x) OVER (PARTITION BY i) AS d FROM v) GROUP BY row_id""",
    "iforest_far": FAR,
    "iforest_bootstrap_far": FAR,
    "lunar_far": FAR,
}
ORACLES |= {
    "run_anomalies": f"""WITH s AS ({ecod('SELECT o_orderkey AS row_id, o_totalprice FROM orders', ['o_totalprice'])})
        SELECT row_id AS o_orderkey, 'price' AS strategy FROM s WHERE score > (SELECT quantile_cont(score, 0.9) FROM s)""",
    "run_metrics": ORACLES["bench_point"],
    "run_grid": f"SELECT round(max(mean_test_score), 4) AS best_score FROM ({ORACLES['grid_search']})",
    "run_no_windows": "SELECT count(*) AS n_rows, 0::BIGINT AS n_metrics FROM region",
    "minmax_model": """SELECT p_partkey AS row_id, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS size,
        round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS price FROM part""",
    "cached_source": "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, true AS kept FROM nation",
}
