"""SQL expressions of the text functions, for the equivalent queries."""

from __future__ import annotations

from citeloom.functions import text as T


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(by)}, 'g')"


def ws(x: str) -> str:
    return f"trim({sub(x, '[' + chr(92) + 's' + chr(92) + 'x{00A0}]+', ' ')}, ' ')"


def keep_handles(x: str) -> str:
    return ws(sub(sub(sub(x, T.MENTION, r"\1\2"), T.HASHTAG, r"\1\2"), T.EMOJI, ""))


def drop_handles(x: str) -> str:
    return ws(sub(sub(sub(sub(x, T.URL, ""), T.MENTION, r"\1"), T.HASHTAG, r"\1\2"), T.EMOJI, ""))


def mask_handles(x: str) -> str:
    return ws(sub(sub(sub(sub(x, T.URL, ""), T.MENTION, r"\1@user"), T.HASHTAG, r"\1\2"), T.EMOJI, ""))


def entities(x: str, mask: bool = False) -> str:
    y = sub(sub(x, T.URL, ""), T.HASHTAG, r"\1\2")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = f"replace({y}, {_q(entity)}, {_q(sign)})"
    y = sub(y, r"[\p{So}\p{Sk}\p{Cs}]", "")
    return ws(sub(y, T.MENTION, r"\1@user") if mask else y)


def fold(x: str) -> str:
    y = f"translate({x}, {_q(T.ACCENTS)}, {_q(T.PLAIN)})"
    for sign, base in T.LIGATURES.items():
        y = f"replace({y}, {_q(sign)}, {_q(base)})"
    return sub(y, r"[^\x00-\x7F]", "")


def every(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {_q(pattern)})"


STOP = "[" + ", ".join(_q(w) for w in T.STOP_EN) + "]"


def kept(tokens: str, least: int, stop: bool = True) -> str:
    rule = f"length(t) >= {least}" + (f" AND NOT list_contains({STOP}, t)" if stop else "")
    return f"list_filter({tokens}, lambda t: {rule})"


def cut(tokens: str, pattern: str = "'s$") -> str:
    return f"list_transform({tokens}, lambda t: regexp_replace(t, {_q(pattern)}, ''))"


def tok_expansion(x: str) -> str:
    y = sub(sub(f"lower(trim({x}, ' '))", T.MENTION, r"\1"), T.HASHTAG, r"\1\2")
    return kept(cut(every(fold(y), r"[a-z0-9_]+(?:'[a-z0-9_]+)?")), 3)


def tok_sparse(x: str) -> str:
    y = sub(sub(x, T.URL, " "), T.MENTION, r"\1 ")
    return kept(every(f"lower(replace({y}, '#', ''))", r"[a-z0-9\-]+"), 1)


def tok_multi(x: str) -> str:
    lowered = f"list_transform({every(x, T.LATIN_TOKEN)}, lambda t: regexp_replace(lower(t), '[''’]s$', ''))"
    return kept(lowered, 3)


def tok_w2v(x: str) -> str:
    y = f"lower({sub(sub(x, T.REFERENCES, ' '), T.LINK, '')})"
    return f"list_filter(string_split({sub(y, r'[^a-z0-9' + chr(92) + '-]+', ' ')}, ' '), lambda t: t <> '')"


def analyze(x: str, social: bool = False) -> str:
    if social:
        x = f"replace({sub(sub(x, T.URL, ' '), T.MENTION, chr(92) + '1 ')}, '#', ' ')"
    return kept(cut(every(f"lower({fold(x)})", r"[a-z0-9]+(?:'[a-z0-9]+)*")), 1)


def cue_score(x: str) -> str:
    tokens = f"list_transform({every(x, T.CUE_TOKEN)}, lambda w: regexp_replace(w, '^[@#]', ''))"
    stop = "[" + ", ".join(_q(w) for w in T.CUE_STOP) + "]"
    title = lambda w: f"(regexp_matches({w}, '^[A-Z]') AND {w} <> upper({w}) AND NOT list_contains({stop}, {w}))"
    return f"""(2 * len(list_distinct({every(x, T.CUE_WORD)})) + 2 * CAST(regexp_matches({x}, {_q(T.CUE_CITED)}) AS INTEGER)
        + len(list_filter({every(x, T.CUE_ACRONYM)}, lambda w: w <> 'RT')) + len(list_filter({tokens}[2:], lambda w: length(w) > 2 AND {title('w')}))
        + 2 * len(list_filter(list_zip({tokens}, {tokens}[2:]), lambda p: coalesce({title('p[1]')} AND {title('p[2]')}, false))))"""


def clean_translation(x: str) -> str:
    y = sub(x, T.ENDS, "")
    for pattern in T.ECHOES:
        y = sub(f"regexp_replace({y}, {_q(pattern)}, '')", T.ENDS, "")
    blank = r"\n(\s*\n)+"
    return sub(f"regexp_replace({y}, {_q(blank)}, chr(10), 'g')", T.ENDS, "")


def joined(tokens: str) -> str:
    return f"array_to_string({tokens}, ' ')"


def doc_text(title: str = "title", abstract: str = "abstract", authors: str = "authors", kind: str = "plain") -> str:
    def some(c: str) -> str:
        return f"nullif({ws(f'coalesce({c}, {_q(str())})')}, '')"

    by = f"'Authors: ' || {some(authors)}"
    if kind == "plain":
        return f"concat_ws(' ', {some(title)}, {some(abstract)})"
    if kind == "labelled":
        return f"concat_ws(' ', concat_ws('. ', {some(title)}, {some(abstract)}), {by})"
    if kind == "authored":
        return f"concat_ws(' ', {some(title)}, {some(abstract)}, {by})"
    return sub(f"coalesce({some(title)}, '') || '. ' || coalesce({some(abstract)}, '')", r"^[. ]+|[. ]+$", "")


#: A text behind the echoes of the query ``clean_translation``.
ECHOED = """CASE qid % 5 WHEN 1 THEN 'user' || chr(10) || 'Translate.' || chr(10) || 'assistant' || chr(10) || text WHEN 2 THEN 'English: ' || chr(10) || chr(10) || text
    WHEN 3 THEN 'Give the translation and nothing else. ' || text ELSE text END"""

#: The deduplicated papers: text, first non-blank record of a key in text order.
CORPUS = f"""corpus AS (
    SELECT pubkey, title, abstract, venue, authors, doc_text FROM (
        SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY doc_text, coalesce(venue, ''), coalesce(authors, '')) AS first_row
        FROM (SELECT *, {doc_text()} AS doc_text FROM collection_data) WHERE pubkey IS NOT NULL AND trim(pubkey, ' ') <> '' AND doc_text <> '')
    WHERE first_row = 1)"""

#: The evaluation queries: one row a qid, with text.
TOPICS = """topics AS (
    SELECT qid, min(text) AS text, min(pubkey) AS gold, min(split) AS split, min(source) AS source FROM eval_queries
    WHERE qid IS NOT NULL AND text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY qid)"""

#: The training queries alike.
TRAIN = """train AS (
    SELECT qid, min(text) AS text, min(pubkey) AS gold, min(source) AS source FROM en_train
    WHERE qid IS NOT NULL AND text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY qid)"""

#: Runs ranked by score, a document once.
RUNS = """runs AS (
    SELECT run_id, qid, docid, score, row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, docid) AS rank
    FROM (SELECT run_id, qid, docid, max(score) AS score FROM run_entry WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY run_id, qid, docid))"""

#: Gold papers of the German queries.
GOLD = "gold AS (SELECT qid, min(pubkey) AS gold FROM final_de_tradottoen_test WHERE qid IS NOT NULL GROUP BY qid)"

#: First relevant rank of every system and query; -1 without.
RANKED = f"""{RUNS}, {GOLD}, systems AS (SELECT DISTINCT run_id FROM runs),
    ranked AS (SELECT s.run_id, g.qid, g.gold, coalesce(min(r.rank), -1) AS rank FROM gold g CROSS JOIN systems s
               LEFT JOIN runs r ON r.run_id = s.run_id AND r.qid = g.qid AND r.docid = g.gold GROUP BY s.run_id, g.qid, g.gold)"""
