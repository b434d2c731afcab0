"""Work lists, commits, patches and projects."""

from pyspark.sql import functions as F

from defectlab import fixtures as fx
from defectlab.catalog.registry import (
    FILES,
    PATCHES,
    TURNS,
    WORKLIST,
    clean_sql,
    path_sql,
    query,
    side_sql,
    terms_sql,
)
from defectlab.functions.diff import joined_lines, parse_patch
from defectlab.operators import changes as ch
from defectlab.operators import examples as ex
from defectlab.operators import relevance as rel
from defectlab.session import scratch_path
from defectlab.sources import (
    flatten_dump,
    missing_pages,
    read_commits,
    read_diffs,
    read_project_commits,
    read_projects,
)


def _texts(df, keys, *cols):
    """Long texts as digests."""
    return df.select(*keys, *[F.md5(c).alias(c) for c in cols])


FIRST = "first AS (SELECT repository, commit_id, filepath, arg_min(coalesce(patch, ''), pos) AS patch FROM files GROUP BY ALL)"


@query(
    "slice_examples_per_source",
    f"""WITH {PATCHES},
    sides AS (SELECT doc_id, source, {side_sql('patch', '-')} AS d, {side_sql('patch', '+')} AS a FROM patches),
    pairs AS (SELECT doc_id, source, {clean_sql('d')} AS d, {clean_sql('a')} AS a FROM sides WHERE d <> '' AND a <> ''),
    once AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY d, a ORDER BY doc_id) = 1),
    examples AS (SELECT source, d AS code, 1 AS label FROM once UNION ALL SELECT source, a, 0 FROM once)
    SELECT source, label, count(*) AS examples, round(avg(len(string_split(code, ' '))), 6) AS avg_tokens
    FROM examples WHERE code <> '' GROUP BY source, label""",
)
def slice_examples_per_source(spark, sf):
    pairs = ch.change_pairs(fx.patches(spark, sf))
    unique = ex.dedup_pairs(ex.clean_pairs(ch.both_sides(pairs, "deleted_lines", "added_lines")), "doc_id")
    examples = ex.to_examples(unique, ["source"])
    tokens = F.size(F.split("code", " "))
    return examples.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("examples"), F.round(F.avg(tokens), 6).alias("avg_tokens")
    )


@query(
    "s3_explode_files",
    f"WITH {FILES} SELECT repository, commit_id, pos, filepath, md5(patch) AS patch FROM files",
)
def s3_explode_files(spark, sf):
    path = scratch_path(spark, "commits")
    fx.commits(spark, sf).write.json(path)
    return _texts(ch.commit_files(read_commits(spark, path)), ["repository", "commit_id", "pos", "filepath"], "patch")


@query(
    "s4_explode_diffs",
    f"""WITH {TURNS} SELECT project_id, commit_id, md5(title) AS title, new_path, md5(diff) AS diff FROM turns""",
)
def s4_explode_diffs(spark, sf):
    commits, diffs = scratch_path(spark, "project_commits"), scratch_path(spark, "diffs")
    titles = F.array(F.struct(F.col("commit_id").alias("id"), "title")).alias("commits")
    fx.project_commits(spark, sf).select("project_id", titles).write.json(commits)
    changed = F.array(F.struct("diff", "new_path")).alias("diffs")
    fx.project_diffs(spark, sf).select("project_id", "commit_id", changed).write.json(diffs)
    joined = read_diffs(spark, diffs).join(read_project_commits(spark, commits), ["project_id", "commit_id"])
    return _texts(joined, ["project_id", "commit_id", "new_path"], "title", "diff")


@query(
    "s4_projects",
    "SELECT DISTINCT (conv_id + 1)::INTEGER AS page, conv_id AS project_id FROM conversations",
)
def s4_projects(spark, sf):
    path = scratch_path(spark, "projects")
    fx.project_pages(spark, sf).write.json(path)
    return read_projects(spark, path).select("page", F.explode("projects.id").alias("project_id"))


@query(
    "s5_missing_pages",
    """SELECT listing, page FROM (SELECT DISTINCT l_orderkey AS listing, unnest(range(1, 8))::INTEGER AS page FROM lineitem) w
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = w.listing AND l.l_linenumber = w.page)""",
)
def s5_missing_pages(spark, sf):
    return missing_pages(fx.listing_pages(spark, sf), ["listing"])


@query(
    "s9_flatten_dump",
    """SELECT d.doc_id::VARCHAR AS file_id, md5(d.text) AS content, l.quality AS label,
    CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS dataset_id,
    CASE lang WHEN 'en' THEN 'Mozilla' WHEN 'de' THEN 'Openstack' ELSE 'Wikimedia' END AS dataset
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def s9_flatten_dump(spark, sf):
    return _texts(flatten_dump(fx.script_dump(spark, sf)), ["file_id", "label", "dataset_id", "dataset"], "content")


@query(
    "f1_validate",
    f"""WITH {WORKLIST} SELECT wl_id, CASE WHEN NOT contains(repository, '/') THEN 'no owner'
      WHEN len(string_split(repository, '/')) <> 2 THEN 'not owner/name'
      WHEN split_part(repository, '/', 1) = '' OR split_part(repository, '/', 2) = '' OR commit_id = '' OR filepath = ''
        THEN 'missing field' ELSE 'ok' END AS verdict FROM worklist""",
)
def f1_validate(spark, sf):
    marked = ch.mark_worklist(fx.worklist(spark, sf))
    return marked.select("wl_id", F.coalesce("reason", F.lit("ok")).alias("verdict"))


@query(
    "f2_yaml_path",
    f"""SELECT doc_id, path, lower(string_split(path, '.')[-1]) IN ('yml', 'yaml') AS yaml
    FROM (SELECT doc_id, {path_sql('doc_id')} AS path FROM documents)""",
)
def f2_yaml_path(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", fx.path_of("doc_id").alias("path"))
    return docs.withColumn("yaml", ch.is_yaml(F.col("path")))


SIDES = f"sides AS (SELECT doc_id, {side_sql('patch', '-')} AS deleted_lines, {side_sql('patch', '+')} AS added_lines FROM patches)"


@query(
    "f3_both_sides",
    f"""WITH {PATCHES}, {SIDES} SELECT doc_id, md5(deleted_lines) AS deleted_lines, md5(added_lines) AS added_lines
    FROM sides WHERE deleted_lines <> '' AND added_lines <> ''""",
)
def f3_both_sides(spark, sf):
    pairs = ch.both_sides(ch.change_pairs(fx.patches(spark, sf)), "deleted_lines", "added_lines")
    return _texts(pairs, ["doc_id"], "deleted_lines", "added_lines")


@query(
    "f4_label_pairs",
    f"""WITH {PATCHES}, {SIDES} SELECT doc_id, md5(deleted_lines) AS deleted_lines, md5(added_lines) AS added_lines,
    1 AS label_before, 0 AS label_after FROM sides""",
)
def f4_label_pairs(spark, sf):
    pairs = ch.label_pairs(ch.change_pairs(fx.patches(spark, sf)))
    return _texts(pairs, ["doc_id", "label_before", "label_after"], "deleted_lines", "added_lines")


@query(
    "j1_match_files",
    f"""WITH {FILES}, {WORKLIST}, {FIRST}
    SELECT wl_id, u.repository, u.commit_id, u.filepath, md5(patch) AS patch
    FROM usable u JOIN first f ON u.repository = f.repository AND u.commit_id = f.commit_id AND u.filepath = f.filepath""",
)
def j1_match_files(spark, sf):
    usable, _ = ch.validate_worklist(fx.worklist(spark, sf))
    return _texts(ch.match_files(usable, fx.commits(spark, sf)), ["wl_id", *ch.FILE_KEY], "patch")


@query(
    "j2_unmatched",
    f"""WITH {FILES}, {WORKLIST},
    marked AS (SELECT wl_id, EXISTS (SELECT 1 FROM files f WHERE f.repository = u.repository AND f.commit_id = u.commit_id) AS c,
      EXISTS (SELECT 1 FROM files f WHERE f.repository = u.repository AND f.commit_id = u.commit_id
              AND f.filepath = u.filepath) AS p FROM usable u)
    SELECT wl_id, CASE WHEN c THEN 'file missing' ELSE 'commit missing' END AS reason FROM marked WHERE NOT p""",
)
def j2_unmatched(spark, sf):
    usable, _ = ch.validate_worklist(fx.worklist(spark, sf))
    return ch.unmatched(usable, fx.commits(spark, sf)).select("wl_id", "reason")


@query(
    "x1_parse_strict",
    f"""WITH {PATCHES}, {SIDES}
    SELECT doc_id, CASE WHEN deleted_lines = '' THEN 0 ELSE len(string_split(deleted_lines, chr(10))) END::INTEGER AS deleted,
      CASE WHEN added_lines = '' THEN 0 ELSE len(string_split(added_lines, chr(10))) END::INTEGER AS added,
      md5(deleted_lines) AS deleted_lines, md5(added_lines) AS added_lines FROM sides""",
)
def x1_parse_strict(spark, sf):
    return _parsed(spark, sf, "strict")


LENIENT = r"""list_transform(list_filter(list_transform(
    list_filter(string_split(patch, chr(10)), lambda l: NOT starts_with(l, '!')),
    lambda l: regexp_replace(l, '\A[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', '')), lambda l: starts_with(l, 'SIGN')),
    lambda l: rtrim(l[2:], chr(13)))"""


@query(
    "x2_parse_lenient",
    f"""WITH {PATCHES}, lists AS (SELECT doc_id, {LENIENT.replace('SIGN', '-')} AS d, {LENIENT.replace('SIGN', '+')} AS a FROM patches)
    SELECT doc_id, len(d)::INTEGER AS deleted, len(a)::INTEGER AS added,
      md5(coalesce(array_to_string(d, chr(10)), '')) AS deleted_lines,
      md5(coalesce(array_to_string(a, chr(10)), '')) AS added_lines FROM lists""",
)
def x2_parse_lenient(spark, sf):
    return _parsed(spark, sf, "lenient")


def _parsed(spark, sf, mode):
    sides = fx.patches(spark, sf).select("doc_id", parse_patch(F.col("patch"), mode).alias("s"))
    return sides.select(
        "doc_id",
        F.size("s.deleted").alias("deleted"),
        F.size("s.added").alias("added"),
        F.md5(joined_lines(F.col("s.deleted"))).alias("deleted_lines"),
        F.md5(joined_lines(F.col("s.added"))).alias("added_lines"),
    )


@query(
    "x3_hunks",
    f"""WITH {PATCHES},
    raw AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
            FROM (SELECT doc_id, string_split(patch, chr(10)) AS ls FROM patches)),
    placed AS (SELECT *, sum(starts_with(l, '@@')::INTEGER) OVER w AS hunk,
               i - max(CASE WHEN starts_with(l, '@@') THEN i END) OVER w AS pos
               FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    kinds AS (SELECT *, CASE WHEN starts_with(l, '-') THEN 'deleted' WHEN starts_with(l, '+') THEN 'added' ELSE 'context' END AS kind
              FROM placed WHERE NOT starts_with(l, '@@'))
    SELECT doc_id, hunk::INTEGER AS hunk, pos::INTEGER AS pos, kind,
      CASE WHEN kind = 'context' THEN l ELSE rtrim(l[2:], chr(13)) END AS line FROM kinds""",
)
def x3_hunks(spark, sf):
    return ch.patch_lines(fx.patches(spark, sf), ["doc_id"])


@query(
    "x4_totals",
    f"""WITH {FILES}, lists AS (SELECT patch, list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '+')) AS a,
      list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, '-')) AS d FROM files)
    SELECT sum(len(a))::BIGINT AS added_lines, sum(len(d))::BIGINT AS deleted_lines,
      count(*) FILTER (patch IS NULL) AS without_patch FROM lists""",
)
def x4_totals(spark, sf):
    return ch.change_totals(ch.commit_files(fx.commits(spark, sf)))


@query(
    "x5_null_patch",
    f"""WITH {FILES} SELECT repository, commit_id, filepath, pos, md5({side_sql('patch', '-')}) AS deleted_lines,
    md5({side_sql('patch', '+')}) AS added_lines FROM files""",
)
def x5_null_patch(spark, sf):
    pairs = ch.change_pairs(ch.commit_files(fx.commits(spark, sf)))
    return _texts(pairs, [*ch.FILE_KEY, "pos"], "deleted_lines", "added_lines")


@query(
    "f9_keywords",
    f"""SELECT doc_id FROM documents WHERE list_has_any({terms_sql('text')}, ['worthless', 'token'])""",
)
def f9_keywords(spark, sf):
    return rel.title_matches(fx.texts(spark, sf), "text", ("worthless", "token")).select("doc_id")


TITLED = """titled AS (SELECT doc_id, coalesce(words[(doc_id % 60 + 1)::INTEGER], 'plain') || ' - ' || lang AS title
  FROM documents, (SELECT {words} AS words))""".format(words=list(rel.KEYWORDS))


@query("f9_fixed_keywords", f"WITH {TITLED} SELECT doc_id, title FROM titled WHERE NOT starts_with(title, 'plain')")
def f9_fixed_keywords(spark, sf):
    """Titles with each of the fixed keywords in turn, and titles without one."""
    word = F.try_element_at(F.array(*map(F.lit, rel.KEYWORDS)), (F.col("doc_id") % 60 + 1).cast("int"))
    titled = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce(word, F.lit("plain")), F.lit(" - "), "lang").alias("title"))
    return rel.title_matches(titled)


VECTORS = f"""{TURNS},
tokens AS (SELECT DISTINCT unnest({terms_sql('title')}) AS token FROM turns),
places AS (SELECT token, ('0x' || substr(md5(token), 8, 1))::INTEGER AS digit,
  ('0x' || substr(md5(token), 1, 7))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id FROM tokens),
vectors AS (SELECT token, CASE WHEN digit < 6 THEN 'NOUN' WHEN digit < 11 THEN 'VERB' ELSE 'ADJ' END AS pos,
  list_transform(embedding, lambda x: x::DOUBLE * ((vec_id % 5 + 1)::DOUBLE / 2)) AS vector
  FROM places JOIN embeddings USING (vec_id)),
keywords AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS k FROM embeddings GROUP BY label),
near AS (SELECT DISTINCT token FROM vectors v WHERE pos IN ('NOUN', 'VERB')
  AND EXISTS (SELECT 1 FROM keywords
    WHERE list_dot_product(v.vector, k) >= 0.3 * sqrt(list_dot_product(v.vector, v.vector)) * sqrt(list_dot_product(k, k)))),
chosen AS (SELECT DISTINCT project_id, commit_id FROM (SELECT project_id, commit_id, unnest({terms_sql('title')}) AS token FROM turns)
  WHERE token IN (SELECT token FROM near))"""


def _relevant(spark, sf):
    return rel.semantic_matches(
        fx.project_commits(spark, sf), fx.token_vectors(spark, sf), fx.keyword_vectors(spark, sf), cutoff=0.3
    )


@query("j3_semantic", f"WITH {VECTORS} SELECT project_id, commit_id FROM chosen")
def j3_semantic(spark, sf):
    return _relevant(spark, sf).select("project_id", "commit_id")


@query("j3_similar_tokens", f"WITH {VECTORS} SELECT token FROM near")
def j3_similar_tokens(spark, sf):
    return rel.similar_tokens(fx.token_vectors(spark, sf), fx.keyword_vectors(spark, sf), 0.3)


@query(
    "j3_tagged",
    f"""WITH {VECTORS},
    used AS (SELECT project_id, commit_id, token,
        ('0x' || substr(md5(commit_id || ':' || (place - 1) || ':' || token), 8, 1))::INTEGER < 11 AS wanted
      FROM (SELECT project_id, commit_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS place
        FROM (SELECT project_id, commit_id, {terms_sql('title')} AS ts FROM turns))),
    marks AS (SELECT embedding::DOUBLE[] AS k FROM embeddings WHERE vec_id % 7 = 0),
    around AS (SELECT DISTINCT token FROM vectors v WHERE EXISTS (SELECT 1 FROM marks
      WHERE list_dot_product(v.vector, k) >= 0.45 * sqrt(list_dot_product(v.vector, v.vector)) * sqrt(list_dot_product(k, k))))
    SELECT DISTINCT project_id, commit_id FROM used WHERE wanted AND token IN (SELECT token FROM around)""",
)
def j3_tagged(spark, sf):
    """A tag for each occurrence, and many keywords."""
    vectors = fx.token_vectors(spark, sf).select("token", "vector")
    return rel.tagged_matches(fx.tagged_tokens(spark, sf), vectors, fx.keyword_table(spark, sf), 0.45)


@query(
    "j4_project_changes",
    f"""WITH {VECTORS}, pairs AS (SELECT project_id, commit_id, title, new_path, {side_sql('diff', '-')} AS before,
      {side_sql('diff', '+')} AS after FROM turns JOIN chosen USING (project_id, commit_id)
      WHERE lower(string_split(new_path, '.')[-1]) IN ('yml', 'yaml'))
    SELECT project_id, commit_id, new_path, md5(title) AS title, md5(before) AS before, md5(after) AS after
    FROM pairs WHERE before <> '' AND after <> ''""",
)
def j4_project_changes(spark, sf):
    pairs = ch.project_changes(_relevant(spark, sf), fx.project_diffs(spark, sf), fx.project_pages(spark, sf))
    return _texts(pairs, ["project_id", "commit_id", "new_path"], "title", "before", "after")


@query("g13_commits_per_project", "SELECT conv_id AS project_id, count(*) AS commits FROM conversations GROUP BY conv_id")
def g13_commits_per_project(spark, sf):
    return ch.commits_per_project(fx.project_commits(spark, sf))
