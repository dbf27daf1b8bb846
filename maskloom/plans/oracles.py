"""The same results as SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from maskloom.functions.draws import threshold
from maskloom.plans.queries import MODELS, N_ENDINGS, N_WORDS, WITHOUT

WORDS = r"regexp_extract_all(lower(strip_accents(text)), '[^\s\p{Z}\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]')"
# every whitespace character, for trim
SPACES = "||".join(
    f"chr({c})" for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
QUALITY = "CASE WHEN doc_id % 53 = 0 THEN 'NaN'::DOUBLE ELSE ((doc_id * 37) % 101) / 100.0::DOUBLE END"


def below(seed: str, key: str, share: float) -> str:
    return f"substr(md5('{seed}:' || {key}), 1, 16) < '{threshold(share)}'"


def two_way(seed: int, key: str, share: float) -> str:
    return f"CASE WHEN {below(seed, key, share)} THEN 'test' ELSE 'train' END"


def three_way(unit: str) -> str:
    return (
        f"CASE WHEN {below(420, 'doc_id', 0.2)} THEN 'test' "
        f"WHEN {below(42, unit, 0.8)} THEN 'train' ELSE 'validation' END"
    )


TEST = below(666, "doc_id", 0.1)
DOCUMENTS = "SELECT '' AS sample, doc_id AS item, text FROM documents"
HELD_OUT = """SELECT 'benchmark' AS sample, item_id::VARCHAR AS item, text FROM benchmark
  UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations"""

VOCABULARY = f"""
wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS word FROM documents WHERE NOT ({TEST})) GROUP BY word),
chars AS (SELECT ch FROM (SELECT unnest(string_split(word, '')) AS ch, cnt FROM wc)
  GROUP BY ch ORDER BY sum(cnt) DESC, ch LIMIT 1000),
frequent AS (SELECT word FROM wc WHERE length(word) > 1 ORDER BY cnt DESC, word LIMIT {N_WORDS}),
endings AS (SELECT '##' || right(word, 2) AS token FROM wc WHERE length(word) >= 4
  GROUP BY 1 ORDER BY sum(cnt) DESC, token LIMIT {N_ENDINGS}),
special AS (SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '<S>', '<T>']) AS token, unnest(range(7)) AS id),
vocab AS (SELECT token, (row_number() OVER (ORDER BY grp, token) + 6)::INT AS id FROM (
  SELECT 0 AS grp, ch AS token FROM chars
  UNION ALL SELECT 1, '##' || ch FROM chars WHERE ch NOT IN ({", ".join(f"'{c}'" for c in WITHOUT)})
  UNION ALL SELECT 2, word FROM frequent UNION ALL SELECT 3, token FROM endings)),
vocab_size AS (SELECT count(*) + 7 AS v FROM vocab)"""

SPELL = """
parts AS (SELECT word, start, unnest(range(1, length(word) - start + 1)) AS size
  FROM (SELECT word, unnest(range(length(word))) AS start FROM spelled WHERE length(word) <= 100)),
longest AS MATERIALIZED (SELECT word, start, max(size) AS size, max_by(id, size) AS id FROM parts
  JOIN vocab ON token = (CASE WHEN start > 0 THEN '##' ELSE '' END) || substring(word, start + 1, size)
  GROUP BY word, start),
walk AS (SELECT word, 0::BIGINT AS done, 0 AS n, NULL::INT AS id FROM spelled
  UNION ALL SELECT w.word, w.done + l.size, w.n + 1, l.id FROM walk w JOIN longest l ON l.word = w.word AND l.start = w.done),
dict AS (SELECT word, CASE WHEN max(done) = length(word) THEN list(id ORDER BY n) FILTER (WHERE n > 0) ELSE [1] END AS ids
  FROM walk GROUP BY word)"""


def encoded(corpus: str, then: str) -> str:
    """``enc(sample, item, ids)`` over a corpus of (sample, item, text), then more."""
    return f"""WITH RECURSIVE {VOCABULARY},
corpus AS ({corpus}),
split_words AS (SELECT sample, item, {WORDS} AS words FROM corpus),
occ AS (SELECT sample, item, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split_words),
spelled AS (SELECT DISTINCT word FROM occ),{SPELL},
joined AS (SELECT sample, item, flatten(list(ids ORDER BY pos)) AS ids FROM occ JOIN dict USING (word) GROUP BY sample, item),
enc AS (SELECT c.sample, c.item, coalesce(j.ids, []::INT[]) AS ids FROM corpus c LEFT JOIN joined j USING (sample, item)),
docs AS (SELECT item AS doc_id, ids, len(ids)::INT AS n_tokens,
  (CASE WHEN len(ids) <= 510 THEN 1 ELSE 1 + ceil((len(ids) - 510) / 254.0) END)::INT AS n_windows FROM enc),
wins AS (SELECT doc_id, win::INT AS win, [2] || ids[win * 254 + 1 : win * 254 + 510] || [3] AS w
  FROM (SELECT doc_id, ids, unnest(range(n_windows)) AS win FROM docs)),
firsts AS (SELECT sample, item, [2] || ids[1:510] || [3] AS w FROM enc)
{then}"""


def grams(table: str, key: str) -> str:
    """Every run of eight words of a text with its place."""
    return f"""SELECT {key}, unnest([array_to_string(w[i + 1:i + 8], ' ') FOR i IN range(0, len(w) - 7)]) AS g,
 unnest(range(0, len(w) - 7)) AS pos FROM (SELECT {key}, regexp_extract_all(
 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
 WHERE len(w) > 7"""


# Passages of 13 words or more whose every eight words stand in a text of the benchmark, gram by gram.
PASSAGES = f"""known AS (SELECT g, min(item_id) AS item FROM ({grams("benchmark", "item_id")}) GROUP BY g),
held AS (SELECT doc_id, pos, g, item, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
 FROM ({grams("documents", "doc_id")}) JOIN known USING (g)),
passages AS (SELECT doc_id, run, min(pos) AS "start", count(*) + 7 AS n_words, arg_min(item, pos) AS item
 FROM held GROUP BY doc_id, run HAVING count(*) >= 6)"""


def documents(then: str) -> str:
    return encoded(DOCUMENTS, then)


def joined(items: str) -> str:
    return f"array_to_string({items}, ' ')"


def words_prefix(then: str) -> str:
    return f"WITH wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word) {then}"


def length_stats(rows: str) -> str:
    return f"""SELECT split, count(*) AS n, min(l)::INT AS min, max(l)::INT AS max, round(avg(l), 6) AS mean,
 round(quantile_cont(l, 0.5), 6) AS median, round(quantile_cont(l, 0.95), 6) AS percentile_95,
 round(quantile_cont(l, 0.99), 6) AS percentile_99 FROM ({rows}) GROUP BY split"""


def described(rows: str, by: str) -> str:
    """``rows`` gives the group columns and ``x``."""
    stats = {
        "count": "count(x)::DOUBLE",
        "mean": "avg(x)",
        "std": "stddev_samp(x)",
        "min": "min(x)",
        "25%": "quantile_cont(x, 0.25)",
        "50%": "quantile_cont(x, 0.5)",
        "75%": "quantile_cont(x, 0.75)",
        "max": "max(x)",
        "median": "median(x)",
    }
    parts = [f"SELECT {by}, '{name}' AS stat, round({sql}, 6) AS value FROM r GROUP BY {by}" for name, sql in stats.items()]
    return f"r AS ({rows}) " + " UNION ALL ".join(parts)


WINDOW_SIZES = """sized AS (SELECT doc_id, win, len(w)::INT AS n_ids,
 (row_number() OVER (ORDER BY doc_id, win) - 1)::BIGINT AS window_index FROM wins)"""
PADDED = """SELECT *, (ceil(max(n_ids) OVER (PARTITION BY batch) / 8.0) * 8)::INT AS padded_length
 FROM (SELECT *, window_index // {batch} AS batch FROM sized)"""

DRAWN = """tok AS (SELECT doc_id, win, unnest(range(len(w)))::INT AS pos, unnest(w) AS label FROM wins),
drawn AS (SELECT *, md5('42:0:' || doc_id || ':' || win || ':' || pos) AS h FROM tok),
chosen AS (SELECT *, CASE WHEN substr(h, 9, 8) < '{mask}' THEN 'mask' WHEN substr(h, 9, 8) < '{random}' THEN 'random'
  ELSE 'keep' END AS action FROM drawn WHERE label NOT IN (0, 2, 3) AND substr(h, 1, 8) < '{share}'),
plan AS (SELECT doc_id, win, pos, label, action, (CASE action WHEN 'mask' THEN 4
  WHEN 'random' THEN ('0x' || substr(h, 17, 8))::BIGINT % (SELECT v FROM vocab_size) ELSE label END)::INT AS new_id FROM chosen)
""".format(mask=threshold(0.8, 8), random=threshold(0.9, 8), share=threshold(0.15, 8))

# Train pairs need the encoded documents, held-out texts their own; both are one corpus told apart by ``sample``.
BOTH = f"SELECT '' AS sample, doc_id::VARCHAR AS item, text FROM documents WHERE NOT ({TEST}) UNION ALL {HELD_OUT}"
PAIRS = """, whole AS (SELECT [2] || ids || [3] AS w FROM enc WHERE sample = ''),
inner_pairs AS (SELECT w[p] AS prev, w[p + 1] AS cur FROM (SELECT w, unnest(range(1, len(w) - 1)) AS p FROM whole)),
bi AS (SELECT prev, cur, count(*) AS cnt FROM inner_pairs GROUP BY ALL),
ctx AS (SELECT prev, sum(cnt) AS n FROM bi GROUP BY prev)"""


def losses(alpha: float) -> str:
    return f"""SELECT sample, item, p::INT AS pos, prev, cur,
  -ln((coalesce(bi.cnt, 0) + {alpha}) / (coalesce(ctx.n, 0) + {alpha} * (SELECT v FROM vocab_size))) AS loss
  FROM held LEFT JOIN bi USING (prev, cur) LEFT JOIN ctx USING (prev)"""


HELD = f"""{PAIRS}, held AS (SELECT sample, item, p, w[p] AS prev, w[p + 1] AS cur
  FROM (SELECT sample, item, w, unnest(range(1, len(w) - 1)) AS p FROM firsts WHERE sample <> ''))"""


def by_text(source: str, weighting: str) -> str:
    if weighting == "token":
        return f"SELECT sample, item, count(*) AS n_tokens, exp(avg(loss)) AS ppl FROM ({source}) GROUP BY ALL"
    return f"""SELECT sample, item, sum(n)::BIGINT AS n_tokens, exp(avg(m)) AS ppl FROM (
  SELECT sample, item, (pos - 1) // 4 AS run, avg(loss) AS m, count(*) AS n FROM ({source}) GROUP BY ALL) GROUP BY sample, item"""


def every_text(weighting: str) -> str:
    return encoded(
        BOTH,
        f"""{HELD}, scored AS ({by_text(losses(1.0), weighting)})
SELECT sample, item, n_tokens, round(ppl, 6) AS ppl FROM ({HELD_OUT}) LEFT JOIN scored USING (sample, item)""",
    )


MODEL_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS model, sample, item, ppl FROM ({by_text(losses(alpha), 'batch')})" for name, alpha in MODELS.items()
)
RUNS = f"SELECT doc_id, win, {three_way(chr(39) + chr(39) + ' || doc_id || ' + chr(39) + ':' + chr(39) + ' || win')} AS split FROM wins"


CAPPED = """SELECT doc_id, win, batch, w FROM (SELECT doc_id, win, batch, room, w,
 row_number() OVER (PARTITION BY batch ORDER BY doc_id, win) AS place FROM wins JOIN (
 SELECT doc_id, idx // 100 AS batch, count(*) OVER (PARTITION BY idx // 100) AS room FROM (
 SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM docs)) USING (doc_id)) WHERE place <= room"""


OWN_LOSS = """SELECT sample, item, p::INT AS pos, p / 512.0 + 1.0::DOUBLE / (1 + w[p + 1]) + len(w) / 1000.0 AS loss
 FROM (SELECT sample, item, w, unnest(range(1, len(w) - 1)) AS p FROM firsts)"""


def discounts(name: str, grams: str) -> str:
    """One row with what to take off counts of one, two, and more."""
    return f"""{name} AS (SELECT CASE WHEN fits THEN x1 ELSE 0.5::DOUBLE END AS d1, CASE WHEN fits THEN x2 ELSE 1.0::DOUBLE END AS d2,
  CASE WHEN fits THEN x3 ELSE 1.5::DOUBLE END AS d3 FROM (SELECT *, least(n1, n2, n3, n4) > 0 AND x1 BETWEEN 0 AND 1
   AND x2 BETWEEN 0 AND 2 AND x3 BETWEEN 0 AND 3 AS fits FROM (
   SELECT *, 1 - 2 * y * n2 / n1 AS x1, 2 - 3 * y * n3 / n2 AS x2, 3 - 4 * y * n4 / n3 AS x3 FROM (
    SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT count(*) FILTER (WHERE n = 1) AS n1,
     count(*) FILTER (WHERE n = 2) AS n2, count(*) FILTER (WHERE n = 3) AS n3,
     count(*) FILTER (WHERE n = 4) AS n4 FROM {grams})))))"""


def contexts(name: str, grams: str, off: str, context: str, least: int = 1) -> str:
    """Total and freed mass of each context."""
    keys = f"{context}, " if context else ""
    return f"""{name} AS (SELECT {keys}sum(n)::DOUBLE AS total, coalesce(sum(n) FILTER (WHERE n < {least}), 0)::DOUBLE
  + d1 * count(*) FILTER (WHERE n = 1 AND n >= {least}) + d2 * count(*) FILTER (WHERE n = 2 AND n >= {least})
  + d3 * count(*) FILTER (WHERE n > 2 AND n >= {least}) AS free FROM {grams}, {off} GROUP BY {keys}d1, d2, d3)"""


def taken(n: str, off: str, least: int = 1) -> str:
    """A kept count less its discount."""
    return f"""CASE WHEN coalesce({n}, 0) < {least} THEN 0::DOUBLE
  ELSE {n} - CASE {n} WHEN 1 THEN {off}.d1 WHEN 2 THEN {off}.d2 ELSE {off}.d3 END END"""


def trigram_losses(least: int) -> str:
    """``loss(sample, item, pos, a, b, c, loss)`` under interpolated Kneser-Ney smoothing."""
    gram = "CASE WHEN p > 1 THEN w[p - 1] ELSE -1 END AS a, w[p] AS b, w[p + 1] AS c"
    return f""", whole AS (SELECT [2] || ids || [3] AS w FROM enc WHERE sample = ''),
tri AS (SELECT a, b, c, count(*) AS n FROM (SELECT {gram} FROM (SELECT w, unnest(range(1, len(w) - 1)) AS p FROM whole)) GROUP BY ALL),
duo AS (SELECT b, c, count(*) AS n FROM tri GROUP BY ALL), uno AS (SELECT c, count(*) AS n FROM duo GROUP BY ALL),
{discounts('off3', 'tri')}, {discounts('off2', 'duo')}, {discounts('off1', 'uno')},
{contexts('ctx3', 'tri', 'off3', 'a, b', least)}, {contexts('ctx2', 'duo', 'off2', 'b')}, {contexts('ctx1', 'uno', 'off1', '')},
held AS (SELECT sample, item, p::INT AS pos, {gram}
  FROM (SELECT sample, item, w, unnest(range(1, len(w) - 1)) AS p FROM firsts WHERE sample <> '')),
grams AS (SELECT DISTINCT a, b, c FROM held),
s1 AS (SELECT a, b, c, ({taken('n', 'off1')} + free * (1.0::DOUBLE / (SELECT v FROM vocab_size))) / total AS one
  FROM grams LEFT JOIN uno USING (c), off1, ctx1),
s2 AS (SELECT a, b, c, coalesce(({taken('n', 'off2')} + free * one) / total, one) AS two
  FROM s1 LEFT JOIN duo USING (b, c) LEFT JOIN ctx2 USING (b), off2),
s3 AS (SELECT a, b, c, -ln(coalesce(({taken('n', 'off3', least)} + free * two) / total, two)) AS loss
  FROM s2 LEFT JOIN tri USING (a, b, c) LEFT JOIN ctx3 USING (a, b), off3),
loss AS (SELECT sample, item, pos, a, b, c, loss FROM held JOIN s3 USING (a, b, c))"""


def oracles() -> dict[str, str]:
    return {
        "parquet_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "comma_csv_roundtrip": "SELECT conv_id, turn, role, text FROM conversations",
        "sample_json_roundtrip": f"SELECT text FROM ({HELD_OUT})",
        "results_roundtrip": """SELECT source AS model, lang AS sample, text, n_chars / 8.0::DOUBLE AS ppl FROM documents""",
        "statistics_roundtrip": f"""WITH {described('SELECT source AS model, lang AS sample, n_chars AS x FROM documents',
 'model, sample')}""",
        "vocabulary_roundtrip": f"""WITH {VOCABULARY} SELECT token, id::INT AS id FROM special UNION ALL SELECT token, id FROM vocab""",
        "vocabulary_file_roundtrip": f"""WITH {VOCABULARY} SELECT token, id::INT AS id FROM special UNION ALL SELECT token, id FROM vocab""",
        "rows_by_index": """SELECT idx, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
 WHERE idx IN (SELECT doc_id FROM labels)""",
        "lookup_hot_keys": """SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n_docs,
 (sum(n_chars) OVER (PARTITION BY source))::BIGINT AS sum_chars FROM documents""",
        "dense_index_text_key": """SELECT source || '/' || doc_id AS key,
 row_number() OVER (ORDER BY source || '/' || doc_id) - 1 AS idx FROM documents""",
        "head_50": f"SELECT doc_id, text FROM documents WHERE {TEST} ORDER BY doc_id LIMIT 50",
        "quantiles_by_ranges": """SELECT event_type, share, round(CASE share WHEN 0.25 THEN a WHEN 0.5 THEN b WHEN 0.75 THEN c ELSE d END, 6) AS value
 FROM (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c,
 quantile_cont(value, 0.99) AS d FROM events GROUP BY event_type), (SELECT unnest([0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS share)""",
        "completeness": """SELECT source, count(*) AS n_expected, count(l.doc_id) AS n_finished, count(*) - count(l.doc_id) AS n_missing
 FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
        "own_scorer": encoded(
            HELD_OUT,
            by_text(OWN_LOSS, "batch"),
        ).replace("exp(avg(m)) AS ppl", "round(exp(avg(m)), 6) AS ppl"),
        "chunk_cap_100": documents(f"SELECT doc_id, win, batch FROM ({CAPPED})"),
        "legacy_corpus_capped": encoded(
            "SELECT '' AS sample, doc_id AS item, text FROM documents WHERE length(text) >= 30",
            f"""SELECT doc_id, win, {two_way(666, 'doc_id', 0.1)} AS split, md5({joined('list_resize(w, 512, 0)')}) AS ids_md5
 FROM ({CAPPED})""",
        ),
        "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "split_roundtrip": f"SELECT doc_id, text FROM documents WHERE {TEST}",
        "explode_results": "SELECT doc_id, source AS model, text, n_chars / 8.0::DOUBLE AS ppl FROM documents",
        "text_length": "SELECT doc_id, length(text) AS text_length FROM documents",
        "filter_min_length": "SELECT doc_id, text FROM documents WHERE length(text) >= 30",
        "strip_text": f"""SELECT doc_id, trim(['', chr(28) || chr(10) || ' ', chr(160) || chr(9), chr(8195) || chr(12288)][doc_id % 4 + 1]
 || text || [chr(133), '', chr(8232) || ' ' || chr(13), chr(11) || chr(12) || ' '][(doc_id + 1) % 4 + 1], {SPACES}) AS text FROM documents""",
        "remove_html": "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS html FROM pages",
        "remove_link": "SELECT page_id, regexp_replace(html, '<a.*\"', '', 'g') AS html FROM pages",
        "filter_quality": f"""SELECT doc_id, pwa FROM (SELECT doc_id, {QUALITY} AS pwa FROM documents)
 WHERE NOT isnan(pwa) AND pwa >= 0.9""",
        "flatten_struct": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "flatten_values": """SELECT conv_id, turn, role AS value FROM conversations
 UNION ALL SELECT conv_id, turn, text FROM conversations""",
        "distinct_text": "SELECT text, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text",
        "dense_index": """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE length(text) >= 30""",
        "head_n": f"SELECT doc_id, text FROM documents WHERE {TEST} ORDER BY doc_id LIMIT 1000",
        "seeded_shuffle_rank": "SELECT doc_id, row_number() OVER (ORDER BY md5('666:' || doc_id)) - 1 AS rank FROM documents",
        "split_threshold": f"SELECT doc_id, {two_way(666, 'doc_id', 0.1)} AS split FROM documents",
        "split_exact": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('420:' || doc_id))
 <= ceil(0.2 * (SELECT count(*) FROM documents)) THEN 'test' ELSE 'train' END AS split FROM documents""",
        "split_exact_train": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id))
 <= floor(0.8 * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'validation' END AS split FROM documents""",
        "split_by_text": """WITH RECURSIVE texts AS (SELECT sha256(text) AS h, count(*) AS s FROM documents GROUP BY 1),
sizes AS (SELECT s, count(*) AS c FROM texts GROUP BY s),
want AS (SELECT ceil(0.2 * count(*))::BIGINT AS w, count(*) AS n FROM documents),
base AS (SELECT s, c, (w * c) // n AS t, row_number() OVER (ORDER BY s DESC) AS i FROM sizes, want),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS take, ((SELECT w FROM want) - sum(s * t))::BIGINT AS r FROM base
 UNION ALL SELECT b.i, b.s, b.t + least(b.c - b.t, r // b.s), r - b.s * least(b.c - b.t, r // b.s)
 FROM walk JOIN base b ON b.i = walk.i + 1),
placed AS (SELECT h, s, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || h)) AS place FROM texts)
SELECT doc_id, CASE WHEN place <= take THEN 'test' ELSE 'train' END AS split
FROM documents JOIN placed ON h = sha256(text) JOIN walk USING (s)""",
        "quantiles_by_source": """SELECT lang, source, share, round(CASE share WHEN 0.05 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS value
 FROM (SELECT lang, source, quantile_cont(n_chars, 0.05) AS a, quantile_cont(n_chars, 0.5) AS b,
 quantile_cont(n_chars, 0.95) AS c FROM documents GROUP BY lang, source), (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS share)""",
        "trigram_loss": encoded(
            BOTH, f"{trigram_losses(1)} SELECT sample, item, pos, a, b, c, round(loss, 6) AS loss FROM loss"
        ),
        "pseudo_ppl_trigram": encoded(
            BOTH,
            f"""{trigram_losses(2)}, scored AS ({by_text('SELECT * FROM loss', 'batch')})
SELECT sample, item, n_tokens, round(ppl, 6) AS ppl FROM ({HELD_OUT}) LEFT JOIN scored USING (sample, item)""",
        ),
        "split_three_way_doc": f"SELECT doc_id, {three_way('doc_id')} AS split FROM documents",
        "split_three_way_window": documents(RUNS),
        "sample_n": f"""SELECT sample, item, text FROM (SELECT *, row_number() OVER (PARTITION BY sample
 ORDER BY md5('42:' || sample || ':' || item)) AS place FROM ({HELD_OUT}))
 WHERE place <= CASE sample WHEN 'benchmark' THEN 30 ELSE 300 END""",
        "sample_5": f"""SELECT doc_id, text FROM documents WHERE {TEST}
 ORDER BY md5('42:' || doc_id) LIMIT 5""",
        "leak_windows": documents(
            f"""SELECT doc_id, count(*) FILTER (WHERE split = 'train') AS n_train,
 count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'test') AS n_test
 FROM ({RUNS}) GROUP BY doc_id HAVING count(DISTINCT split) > 1"""
        ),
        "leak_recipes": f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('666:' || doc_id)) - 1 AS a,
 row_number() OVER (ORDER BY doc_id) - 1 AS b FROM documents)
 WHERE NOT ({below(420, 'a', 0.2)}) AND {below(420, 'b', 0.2)}""",
        "leak_text": f"""SELECT sha256(text) AS text_hash, count(*) FILTER (WHERE NOT t) AS n_train, 0::BIGINT AS n_validation,
 count(*) FILTER (WHERE t) AS n_test FROM (SELECT text, {TEST} AS t FROM documents)
 GROUP BY text HAVING count(DISTINCT t) > 1""",
        "leak_passages": f"""WITH {PASSAGES} SELECT doc_id, "start", n_words, item FROM passages""",
        "leaked_items": f"""WITH {PASSAGES},
leaked AS (SELECT DISTINCT g FROM held JOIN passages USING (doc_id, run)),
items AS ({grams("benchmark", "item_id")}),
runs AS (SELECT item_id, count(*) AS n FROM (SELECT item_id, pos - row_number() OVER (PARTITION BY item_id ORDER BY pos) AS run
 FROM items SEMI JOIN leaked USING (g)) GROUP BY item_id, run)
SELECT item_id, (SELECT count(*) FROM items i WHERE i.item_id = b.item_id) AS n_grams,
 coalesce((SELECT sum(n) FROM runs r WHERE r.item_id = b.item_id), 0)::BIGINT AS n_leaked,
 coalesce((SELECT max(n) + 7 FROM runs r WHERE r.item_id = b.item_id), 0)::BIGINT AS longest FROM benchmark b""",
        "pretokenize": f"""SELECT doc_id, len(w) AS n_words, {joined('w')} AS words FROM (SELECT doc_id, {WORDS} AS w FROM documents)""",
        "word_counts": words_prefix("SELECT word, cnt FROM wc"),
        "wp_alphabet": words_prefix(
            """SELECT ch, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch, cnt FROM wc)
 GROUP BY ch ORDER BY 2 DESC, ch LIMIT 1000"""
        ),
        "wp_pair_counts": words_prefix(
            """SELECT CASE WHEN p > 1 THEN '##' ELSE '' END || word[p] AS "left", '##' || word[p + 1] AS "right",
 sum(cnt)::BIGINT AS cnt FROM (SELECT word, cnt, unnest(range(1, length(word))) AS p FROM wc) GROUP BY 1, 2"""
        ),
        "basic_vocabulary": f"""WITH {VOCABULARY} SELECT token, id::INT AS id FROM special UNION ALL SELECT token, id FROM vocab""",
        "wordpiece_encode": f"""WITH RECURSIVE {VOCABULARY},
spelled AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word),{SPELL}
SELECT word, cnt, {joined('ids')} AS ids FROM dict JOIN spelled USING (word)""",
        "wordpiece_documents": documents(f"SELECT doc_id, len(ids) AS n_tokens, {joined('ids')} AS ids FROM docs"),
        "oov_rate": encoded(
            f"SELECT '' AS sample, doc_id AS item, text FROM documents WHERE {TEST} ORDER BY doc_id LIMIT 1000",
            """SELECT sum(len(ids))::BIGINT AS n_tokens, sum(len(list_filter(ids, lambda i: i = 1)))::BIGINT AS n_unknown,
 round(sum(len(list_filter(ids, lambda i: i = 1))) * 100.0 / sum(len(ids)), 6) AS oov_percent FROM docs""",
        ),
        "windows_per_doc": documents("SELECT doc_id, n_tokens, n_windows FROM docs"),
        "token_windows": documents(f"SELECT doc_id, win, len(w)::INT AS n_ids, {joined('w')} AS input_ids FROM wins"),
        "special_masks": documents(
            f"""SELECT doc_id, {joined('[2] || ids || [3]')} AS input_ids,
 {joined('list_resize([1], len(ids) + 2, 1)')} AS attention_mask,
 {joined('[1] || list_resize([]::INT[], len(ids), 0) || [1]')} AS special_tokens_mask FROM docs"""
        ),
        "special_masks_literal": documents(
            f""", v AS (SELECT max(id) FILTER (WHERE token = 'a') AS a, max(id) FILTER (WHERE token = 'b') AS b FROM vocab),
 lit AS (SELECT doc_id, [0, a, 3] || ids || [4, b, 2] AS ids FROM docs, v),
 cut AS (SELECT doc_id, win::INT AS win, [2] || ids[win * 254 + 1 : win * 254 + 510] || [3] AS w FROM (
  SELECT doc_id, ids, unnest(range((CASE WHEN len(ids) <= 510 THEN 1 ELSE 1 + ceil((len(ids) - 510) / 254.0) END)::INT)) AS win
  FROM lit))
SELECT doc_id, win, {joined('list_resize(w, 512, 0)')} AS input_ids,
 {joined('list_resize(list_resize([1], len(w), 1), 512, 0)')} AS attention_mask,
 {joined('list_resize([1] || list_resize([]::INT[], len(w) - 2, 0), 512, 1)')} AS special_tokens_mask FROM cut"""
        ),
        "truncate_first": documents(f"SELECT item AS doc_id, {joined('w')} AS input_ids FROM firsts"),
        "pad_static": documents(
            f"""SELECT doc_id, win, {joined('list_resize(w, 512, 0)')} AS input_ids,
 {joined('list_resize(list_resize([1], len(w), 1), 512, 0)')} AS attention_mask FROM wins"""
        ),
        "pad_dynamic": documents(f", {WINDOW_SIZES} {PADDED.format(batch=16)}"),
        "padding_waste": documents(
            f""", {WINDOW_SIZES} SELECT count(DISTINCT batch) AS n_batches, count(*) AS n_windows, sum(n_ids)::BIGINT AS real_ids,
 sum(padded_length)::BIGINT AS dynamic_ids, count(*) * 512 AS static_ids FROM ({PADDED.format(batch=32)})"""
        ),
        "chunk_cap": documents(
            """SELECT doc_id, win, batch FROM (SELECT doc_id, win, batch, room,
 row_number() OVER (PARTITION BY batch ORDER BY doc_id, win) AS place FROM wins JOIN (
 SELECT doc_id, idx // 1000 AS batch, count(*) OVER (PARTITION BY idx // 1000) AS room FROM (
 SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM docs)) USING (doc_id)) WHERE place <= room"""
        ),
        "token_length_stats": documents(
            length_stats(f"SELECT {two_way(666, 'doc_id', 0.1)} AS split, n_tokens + 2 AS l FROM docs")
        ),
        "mlm_mask_plan": documents(f", {DRAWN} SELECT * FROM plan"),
        "mlm_masked_windows": documents(
            f""", {DRAWN} SELECT doc_id, win, string_agg(coalesce(new_id, tok.label), ' ' ORDER BY pos) AS input_ids,
 string_agg(coalesce(plan.label, -100), ' ' ORDER BY pos) AS labels
 FROM tok LEFT JOIN plan USING (doc_id, win, pos) GROUP BY doc_id, win"""
        ),
        "mlm_mask_rates": documents(
            f""", {DRAWN} SELECT (SELECT count(*) FROM tok WHERE label NOT IN (0, 2, 3)) AS n_maskable, count(*) AS n_chosen,
 count(*) FILTER (WHERE action = 'mask') AS n_mask, count(*) FILTER (WHERE action = 'random') AS n_random,
 count(*) FILTER (WHERE action = 'keep') AS n_keep FROM plan"""
        ),
        "pppl_expand": encoded(
            HELD_OUT,
            f"""SELECT sample, item, p::INT AS pos, w[p + 1] AS label, md5({joined('w[1:p] || [4] || w[p + 2:]')}) AS masked_md5
 FROM (SELECT sample, item, w, unnest(range(1, len(w) - 1)) AS p FROM firsts)""",
        ),
        "bigram_counts": encoded(BOTH, f"{PAIRS} SELECT * FROM bi"),
        "bigram_loss": encoded(
            BOTH, f"{HELD} SELECT sample, item, pos, prev, cur, round(loss, 6) AS loss FROM ({losses(1.0)})"
        ),
        "pseudo_ppl_batch4": every_text("batch"),
        "pseudo_ppl_token": every_text("token"),
        "corpus_ppl": encoded(
            f"SELECT {two_way(666, 'doc_id', 0.1)} AS sample, doc_id AS item, text FROM documents",
            """, whole AS (SELECT sample, [2] || ids || [3] AS w FROM enc),
pairs AS (SELECT sample, w[p] AS prev, w[p + 1] AS cur FROM (SELECT sample, w, unnest(range(1, len(w) - 1)) AS p FROM whole)),
bi AS (SELECT prev, cur, count(*) AS cnt FROM pairs WHERE sample = 'train' GROUP BY ALL),
ctx AS (SELECT prev, sum(cnt) AS n FROM bi GROUP BY prev)
SELECT split, count(*) AS n_tokens, round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity FROM (
 SELECT sample AS split, -ln((coalesce(bi.cnt, 0) + 1.0) / (coalesce(ctx.n, 0) + 1.0 * (SELECT v FROM vocab_size))) AS loss
 FROM pairs LEFT JOIN bi USING (prev, cur) LEFT JOIN ctx USING (prev)) GROUP BY split""",
        ),
        "ppl_describe": encoded(
            BOTH, f"{HELD}, {described(f'SELECT model, sample, ppl AS x FROM ({MODEL_ROWS})', 'model, sample')}"
        ),
        "events_describe": f"WITH {described('SELECT event_type, value AS x FROM events', 'event_type')}",
        "missing_results": f"SELECT doc_id FROM documents WHERE {TEST} AND doc_id NOT IN (SELECT doc_id FROM labels)",
        "model_compare": encoded(
            BOTH,
            f"""{HELD}, r AS (SELECT * FROM ({MODEL_ROWS}) WHERE ppl IS NOT NULL),
best AS (SELECT sample, item, arg_min(model, (ppl, model)) AS model FROM r GROUP BY sample, item),
won AS (SELECT sample, model, count(*) AS wins FROM best GROUP BY ALL)
SELECT sample, model, count(*) AS n_texts, round(avg(ppl), 6) AS mean_ppl, coalesce(any_value(wins), 0) AS wins
FROM r LEFT JOIN won USING (sample, model) GROUP BY sample, model""",
        ),
        "legacy_corpus": encoded(
            "SELECT '' AS sample, doc_id AS item, text FROM documents WHERE length(text) >= 30",
            f"""SELECT doc_id, win, {two_way(666, 'doc_id', 0.1)} AS split, md5({joined('list_resize(w, 512, 0)')}) AS ids_md5 FROM wins""",
        ),
        "current_corpus": encoded(
            f"""SELECT '' AS sample, doc_id AS item, text FROM (SELECT *, {QUALITY} AS pwa FROM documents)
 WHERE NOT isnan(pwa) AND pwa >= 0.9""",
            f"SELECT doc_id, win, {three_way('doc_id')} AS split, md5({joined('w')}) AS ids_md5 FROM wins",
        ),
        "split_word_stats": length_stats(
            f"SELECT {two_way(666, 'doc_id', 0.1)} AS split, len({WORDS}) AS l FROM documents WHERE length(text) >= 30"
        ),
    }
