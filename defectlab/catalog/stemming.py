"""Porter's rules written out in SQL, to check the stemmer with."""

# The published suffix rules, stated here anew and not taken from the code they check.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

CONS, VOW = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_OVER_0 = f"^({CONS})?{VOW}{CONS}"
M_IS_1 = f"^({CONS})?{VOW}{CONS}({VOW})?$"
M_OVER_1 = f"^({CONS})?{VOW}{CONS}{VOW}{CONS}"
HAS_VOWEL = f"^({CONS})?[aeiouy]"
CVC = f"^{CONS}[aeiouy][^aeiouwxy]$"


def _like(text, pattern):
    return f"regexp_matches({text}, '{pattern}')"


def _without(n):
    return f"left(w, length(w) - {n})"


def _rules(rules, condition):
    cases = []
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _without(len(suffix))
        changed = f"{stem} || '{new}'"
        test = condition(stem, suffix)
        result = f"CASE WHEN {test} THEN {changed} ELSE w END" if test else changed
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN {result}")
    return f"CASE {' '.join(cases)} ELSE w END"


def _step_4_test(stem, suffix):
    long_enough = _like(stem, M_OVER_1)
    return f"{long_enough} AND right({stem}, 1) IN ('s', 't')" if suffix == "ion" else long_enough


def _steps(source):
    """CTEs from ``source(token)`` to ``stems(token, stem)``."""
    over_0 = lambda stem, _: _like(stem, M_OVER_0)
    return f"""
    p0 AS (SELECT token, CASE WHEN starts_with(token, 'y') THEN 'Y' || token[2:] ELSE token END AS w FROM {source} WHERE length(token) > 2),
    p1 AS (SELECT token, {_rules(STEP_1A, lambda *_: None)} AS w FROM p0),
    p2 AS (SELECT token, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_like(_without(3), M_OVER_0)} THEN {_without(1)} ELSE w END
        WHEN ends_with(w, 'ed') AND {_like(_without(2), HAS_VOWEL)} THEN {_without(2)}
        WHEN ends_with(w, 'ing') AND {_like(_without(3), HAS_VOWEL)} THEN {_without(3)} ELSE w END AS w,
        NOT ends_with(w, 'eed') AND ((ends_with(w, 'ed') AND {_like(_without(2), HAS_VOWEL)})
          OR (ends_with(w, 'ing') AND {_like(_without(3), HAS_VOWEL)})) AS cut FROM p1),
    p3 AS (SELECT token, CASE WHEN NOT cut THEN w
        WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
        WHEN length(w) > 1 AND w[-1] = w[-2] AND w[-1] NOT IN ('a','e','i','o','u','y','l','s','z') THEN {_without(1)}
        WHEN {_like('w', CVC)} THEN w || 'e' ELSE w END AS w FROM p2),
    p4 AS (SELECT token, CASE WHEN ends_with(w, 'y') AND {_like(_without(1), HAS_VOWEL)} THEN {_without(1)} || 'i' ELSE w END AS w FROM p3),
    p5 AS (SELECT token, {_rules(STEP_2, over_0)} AS w FROM p4),
    p6 AS (SELECT token, {_rules(STEP_3, over_0)} AS w FROM p5),
    p7 AS (SELECT token, {_rules([(s, '') for s in STEP_4], _step_4_test)} AS w FROM p6),
    p8 AS (SELECT token, CASE WHEN ends_with(w, 'e') AND ({_like(_without(1), M_OVER_1)} OR ({_like(_without(1), M_IS_1)}
        AND NOT {_like(_without(1), CVC)})) THEN {_without(1)} ELSE w END AS w FROM p7),
    p9 AS (SELECT token, CASE WHEN ends_with(w, 'll') AND {_like('w', M_OVER_1)} THEN {_without(1)} ELSE w END AS w FROM p8),
    stems AS (SELECT token, CASE WHEN starts_with(w, 'Y') THEN 'y' || w[2:] ELSE w END AS stem FROM p9
      UNION ALL SELECT token, token FROM {source} WHERE length(token) <= 2)"""


STEMS = _steps("vocab")


def stemmed_sql(text):
    """Each document's blank-separated tokens stemmed and put back in order."""
    return f"""WITH toks AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM
      (SELECT doc_id, string_split({text}, ' ') AS ts FROM documents)),
    seen AS (SELECT DISTINCT token FROM toks), {_steps('seen')}
    SELECT doc_id, md5(string_agg(stem, ' ' ORDER BY i)) AS result FROM toks JOIN stems USING (token) GROUP BY doc_id"""
