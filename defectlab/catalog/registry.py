from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Blanks as a class both engines read alike.
BLANKS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
NON_WORD = r"[^\p{L}\p{N}_]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            SQL[name] = sql
        return made

    return add


def patch_sql(text: str) -> str:
    """The patch fixture of a text column."""
    return rf"""coalesce(array_to_string(list_transform(
        list_filter(string_split({text}, chr(10)), lambda l: l <> ''),
        lambda l, i: CASE WHEN (i - 1) % 6 = 0 THEN '@@ -' || i || ',6 +' || i || ',6 @@' || chr(10) ELSE '' END
          || CASE (i - 1) % 5 WHEN 0 THEN '-' || l WHEN 1 THEN '+' || l || chr(13) WHEN 2 THEN '  -' || l
             WHEN 3 THEN ' ' || l ELSE '!' || l END), chr(10)), '')"""


def path_sql(key: str) -> str:
    return f"""'roles/r' || ({key} % 7) || '/main.' || CASE {key} % 4 WHEN 0 THEN 'yml' WHEN 1 THEN 'YAML'
        WHEN 2 THEN 'py' ELSE 'j2' END"""


def side_sql(patch: str, sign: str) -> str:
    """Deleted or added lines of a patch, joined."""
    return f"""coalesce(array_to_string(list_transform(
        list_filter(string_split({patch}, chr(10)), lambda l: starts_with(l, '{sign}')),
        lambda l: rtrim(l[2:], chr(13))), chr(10)), '')"""


def clean_sql(text: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({text}, '')), '{BLANKS}', ' ', 'g'))"


def collapse_sql(text: str) -> str:
    return rf"trim(regexp_replace({text}, '{BLANKS}', ' ', 'g'))"


def terms_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '{NON_WORD}'), lambda t: t <> '')"


PATCHES = f"patches AS (SELECT doc_id, source, lang, {patch_sql('text')} AS patch FROM documents)"

FILES = f"""files AS (
  SELECT 'org/' || source AS repository, md5(doc_id::VARCHAR) AS commit_id, 0 AS pos,
         {path_sql('doc_id')} AS filepath, {patch_sql('text')} AS patch FROM documents
  UNION ALL SELECT 'org/' || source, md5(doc_id::VARCHAR), 1, 'README.md', NULL FROM documents
  UNION ALL SELECT 'org/' || source, md5(doc_id::VARCHAR), 2, {path_sql('doc_id')},
         '@@ -1 +1 @@' || chr(10) || '-again' FROM documents)"""

WORKLIST = f"""worklist AS (SELECT doc_id AS wl_id,
  CASE source WHEN 'src7' THEN 'org' || source WHEN 'src8' THEN 'org/' || source || '/x'
       ELSE 'org/' || source END AS repository,
  CASE WHEN source = 'src9' THEN '' WHEN lang = 'es' THEN md5('x' || doc_id) ELSE md5(doc_id::VARCHAR) END AS commit_id,
  CASE WHEN lang = 'fr' THEN 'roles/r99/main.yml' ELSE {path_sql('doc_id')} END AS filepath
  FROM documents),
usable AS (SELECT * FROM worklist WHERE source_ok(repository) AND commit_id <> '' AND filepath <> '')""".replace(
    "source_ok(repository)",
    "len(string_split(repository, '/')) = 2 AND split_part(repository, '/', 1) <> '' AND split_part(repository, '/', 2) <> ''",
)

SCRIPTS = """scripts AS (SELECT d.doc_id AS script_id, d.text AS content, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TURNS = f"""turns AS (SELECT conv_id AS project_id, md5(conv_id || ':' || turn) AS commit_id, text AS title,
  {path_sql('turn')} AS new_path, {patch_sql('text')} AS diff FROM conversations)"""

POSTINGS = f"""postings AS (SELECT doc_id, term, count(*) AS tf FROM
  (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY doc_id, term)"""

PREDICTIONS = """predictions AS (SELECT doc_id AS example_id, quality AS label, score,
  CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction, (doc_id % 8)::INTEGER AS fold,
  CASE WHEN toxic = 1 THEN 'validation' ELSE 'test' END AS phase
  FROM (SELECT *, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM labels))"""

RUNS = """runs AS (SELECT event_type AS model, event_id AS run, (event_id * 37 % 1009) / 1009.0::DOUBLE AS auc,
  user_id / 150.0::DOUBLE AS precision, value / 500.0::DOUBLE AS recall,
  (user_id / 150.0::DOUBLE + value / 500.0::DOUBLE) / 2 AS f1 FROM events)"""


def holdout_sql(rows: str, key: str, fraction: float, seed: str, by: str = "") -> str:
    """Exact split by plain ranks: rows with ``split`` test or train."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, CASE WHEN row_number() OVER ({part} ORDER BY md5(({seed}) || ':' || {key}), {key})
      <= ceil(count(*) OVER ({part}) * {fraction}::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {rows}"""
