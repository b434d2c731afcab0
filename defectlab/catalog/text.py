"""Text functions; long results are shown as digests."""

from pyspark.sql import functions as F

from defectlab import fixtures as fx
from defectlab.catalog.registry import SCRIPTS, clean_sql, collapse_sql, query, terms_sql
from defectlab.catalog.stemming import STEMS, stemmed_sql
from defectlab.functions import text as tx
from defectlab.functions.text import clean_text
from defectlab.operators import examples as ex
from defectlab.operators import features as ft
from defectlab.session import scratch_path
from defectlab.sources import read_scripts
from defectlab.sources.writers import write_csv_text


def _docs(spark, sf, made):
    docs = fx.texts(spark, sf)
    return docs.select("doc_id", F.md5(made(F.col("text"))).alias("result"))


def _sql(expr):
    return f"SELECT doc_id, md5({expr}) AS result FROM documents"


PUNCT = r"[!-/:-@\[-`{-~]"
CONTROLS = r"[\x00-\x1f\x7f]"


def _blank_controls(t):
    return rf"regexp_replace({t}, '{CONTROLS}', ' ', 'g')"


def _drop_short(t):
    """Words are marked first, then short marked ones go, then the marks."""
    marked = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    return rf"regexp_replace(regexp_replace({marked}, '\x01[\p{{L}}\p{{N}}_]{{1,2}}\x02', '', 'g'), '[\x01\x02]', '', 'g')"


def _latin1(t):
    return rf"regexp_replace({t}, '[^\x{{00}}-\x{{ff}}]', '', 'g')"


def _trim_lower(t):
    return f"lower(trim({t}))"


@query("t1_clean", _sql(clean_sql("text")))
def t1_clean(spark, sf):
    return _docs(spark, sf, tx.clean_text)


@query(
    "t2_strip_comments",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '#[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g')) AS result
    FROM pages""",
)
def t2_strip_comments(spark, sf):
    pages = fx.texts(spark, sf, "pages")
    return pages.select("page_id", F.md5(tx.strip_comments(F.col("html"))).alias("result"))


@query("t3_apostrophes", _sql("replace(text, chr(39), '')"))
def t3_apostrophes(spark, sf):
    return _docs(spark, sf, tx.drop_apostrophes)


@query("t4_controls", _sql(_blank_controls("text")))
def t4_controls(spark, sf):
    return _docs(spark, sf, tx.blank_controls)


@query("t5_trim_lower", _sql(_trim_lower("text")))
def t5_trim_lower(spark, sf):
    return _docs(spark, sf, tx.trim_lower)


@query("t6_short_words", _sql(collapse_sql(_drop_short(_trim_lower(_blank_controls("text"))))))
def t6_short_words(spark, sf):
    return _docs(spark, sf, lambda c: tx.collapse_blanks(tx.drop_short_words(tx.trim_lower(tx.blank_controls(c)))))


@query("t7_latin1", _sql(_latin1("text")))
def t7_latin1(spark, sf):
    return _docs(spark, sf, tx.drop_beyond_latin1)


@query(
    "t8_normalize",
    _sql(collapse_sql(_latin1(_drop_short(_trim_lower(_blank_controls("replace(text, chr(39), '')")))))),
)
def t8_normalize(spark, sf):
    return _docs(spark, sf, tx.normalize_script)


@query(
    "t10_punctuation",
    _sql(
        collapse_sql(
            _latin1(
                _drop_short(
                    _trim_lower(
                        _blank_controls(rf"regexp_replace(replace(text, chr(39), ''), '{PUNCT}', ' ', 'g')")
                    )
                )
            )
        )
    ),
)
def t10_punctuation(spark, sf):
    return _docs(spark, sf, lambda c: tx.normalize_script(c, strip_punct=True))


VOCABULARY = f"vocab AS (SELECT token, count(*) AS n FROM (SELECT unnest({terms_sql('text')}) AS token FROM documents) GROUP BY token)"


def _vocabulary(spark, sf):
    return ft.token_counts(fx.texts(spark, sf), "text")


@query("t9_stem_vocabulary", f"WITH {VOCABULARY}, {STEMS} SELECT token, stem, n FROM stems JOIN vocab USING (token)")
def t9_stem_vocabulary(spark, sf):
    return ft.stem_vocabulary(_vocabulary(spark, sf))


@query(
    "t9_conflate",
    f"""WITH {VOCABULARY}, {STEMS} SELECT stem, sum(n)::BIGINT AS n, count(*) AS tokens
    FROM stems JOIN vocab USING (token) GROUP BY stem""",
)
def t9_conflate(spark, sf):
    return ft.conflate(ft.stem_vocabulary(_vocabulary(spark, sf)))


NORMAL = collapse_sql(_latin1(_drop_short(_trim_lower(_blank_controls("replace(text, chr(39), '')")))))


@query("t9_stem_text", stemmed_sql(NORMAL))
def t9_stem_text(spark, sf):
    docs = fx.texts(spark, sf).select("doc_id", tx.normalize_script(F.col("text")).alias("content"))
    return ft.stemmed(docs, "content").select("doc_id", F.md5("stemmed").alias("result"))


@query(
    "t11_token_stats",
    f"""SELECT max(n)::INTEGER AS max_tokens, sum(n)::BIGINT AS tokens, count(*) AS rows FROM
    (SELECT len(list_filter(string_split({collapse_sql('text')}, ' '), lambda t: t <> '')) AS n FROM documents)""",
)
def t11_token_stats(spark, sf):
    return ft.token_stats(fx.texts(spark, sf), "text")


@query(
    "t12_vocab_lengths",
    f"WITH {VOCABULARY} SELECT length(token)::INTEGER AS length, count(*) AS tokens FROM vocab GROUP BY length(token)",
)
def t12_vocab_lengths(spark, sf):
    return ft.vocab_lengths(_vocabulary(spark, sf))


@query(
    "t12_vocab_range",
    f"""WITH {VOCABULARY} SELECT min(length(token))::INTEGER AS min_length, max(length(token))::INTEGER AS max_length,
    count(*) AS tokens FROM vocab""",
)
def t12_vocab_range(spark, sf):
    return ft.vocab_length_range(_vocabulary(spark, sf))


def _windows_sql(stride, width):
    return f"""WITH {SCRIPTS}, flat AS (SELECT script_id, label, {collapse_sql('content')} AS code FROM scripts),
    cut AS (SELECT script_id, label, unnest(CASE WHEN len(string_split(code, ' ')) < 510 THEN [code] ELSE
      list_transform(range(0, length(code), {stride}), lambda s: substr(code, s + 1, {width})) END) AS piece,
      generate_subscripts(CASE WHEN len(string_split(code, ' ')) < 510 THEN [0] ELSE
      range(0, length(code), {stride}) END, 1) - 1 AS w FROM flat)
    SELECT script_id, label, w::INTEGER AS w, length(piece)::INTEGER AS chars, md5(piece) AS piece FROM cut"""


def _windows(spark, sf, **shape):
    pieces = F.posexplode(tx.char_windows(F.col("content"), 512, **shape)).alias("w", "piece")
    cut = fx.scripts(spark, sf).select("script_id", "label", pieces)
    return cut.select("script_id", "label", "w", F.length("piece").alias("chars"), F.md5("piece").alias("piece"))


@query("t13_windows", _windows_sql(510, 510))
def t13_windows(spark, sf):
    return _windows(spark, sf)


@query("t13_windows_gapped", _windows_sql(510, 508))
def t13_windows_gapped(spark, sf):
    return _windows(spark, sf, width=508)


@query(
    "t14_fit_length",
    f"""WITH {SCRIPTS}, toks AS (SELECT script_id, label,
      list_filter(string_split({collapse_sql('content')}, ' '), lambda t: t <> '')[1:1498] AS t FROM scripts)
    SELECT script_id, label, (len(t) + 2)::INTEGER AS kept, 1500 AS length,
      md5('<s> ' || array_to_string(t, ' ') || CASE WHEN len(t) > 0 THEN ' ' ELSE '' END || '</s>' || repeat(' <pad>', (1498 - len(t))::INTEGER)) AS tokens
    FROM toks""",
)
def t14_fit_length(spark, sf):
    fitted = fx.scripts(spark, sf).select("script_id", "label", tx.fit_length(F.col("content"), 1500).alias("f"))
    return fitted.select(
        "script_id",
        "label",
        F.aggregate("f.mask", F.lit(0), lambda a, x: a + x).alias("kept"),
        F.size("f.tokens").alias("length"),
        F.md5(F.array_join("f.tokens", " ")).alias("tokens"),
    )


@query("f5_drop_null", f"WITH {SCRIPTS} SELECT script_id, md5({clean_sql('content')}) AS content FROM scripts WHERE script_id % 7 <> 0")
def f5_drop_null(spark, sf):
    """Every seventh script is written without its content, read back and dropped."""
    path = scratch_path(spark, "gaps")
    content = F.when(F.col("script_id") % 7 != 0, F.col("content"))
    gaps = fx.scripts(spark, sf).select("script_id", content.alias("Script.Content"), F.col("label").alias("Defect.Label"))
    write_csv_text(gaps, path)
    kept = ex.drop_null(read_scripts(spark, path, "UTF-8"), ["content"])
    return kept.select(F.col("script_id").cast("long").alias("script_id"), F.md5(clean_text(F.col("content"))).alias("content"))


@query(
    "f6_non_blank",
    rf"""SELECT doc_id, pos FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1)::INTEGER - 1 AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE {collapse_sql('l')} <> ''""",
)
def f6_non_blank(spark, sf):
    docs = fx.texts(spark, sf)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return ex.keep_non_blank(lines, "line").select("doc_id", "pos")
