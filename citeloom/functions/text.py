"""Text functions as columns: cleaning, tokenising, term features. All stay on the JVM inside code generation.

Patterns avoid look-around and ``\\B``, so that the same expressions can be checked in another SQL engine. Letters in ``\\w``-like
classes are written out as ASCII or Latin ranges.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"https?://[^\s]+|www\.[^\s]+"
MENTION = r"(^|[^A-Za-z0-9_])@([A-Za-z0-9_]+)"
HASHTAG = r"(^|[^A-Za-z0-9_])#([A-Za-z0-9_]+)"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{200D}\x{FE0F}]"


def _folds() -> tuple[str, str, dict[str, str]]:
    """(characters with one ASCII letter or sign as compatibility decomposition, those, characters with several): Latin letters with marks, ligatures, wide forms."""
    single, plain, several = [], [], {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            single.append(chr(code))
            plain.append(base)
        elif base:
            several[chr(code)] = base
    return "".join(single), "".join(plain), several


ACCENTS, PLAIN, LIGATURES = _folds()
#: Word runs of Latin script, with an inner apostrophe or hyphen.
LATIN_TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+(?:['’\-][A-Za-zÀ-ÖØ-öø-ÿ0-9]+)*"
#: A short English stop list.
STOP_EN = tuple(
    "a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or our she so that the their them then there these they this to was we were what when where which who will with would you your".split()
)
#: Marks and names taken out of training texts, and links there.
REFERENCES, LINK = r"\[[0-9]+\]|\([0-9]+\)|Google Scholar|Crossref|PubMed", r"http[^\s]+"
ENDS = r"^\s+|\s+$"
#: Tokens of posts, and the parts of a hashtag.
SOCIAL_TOKEN, TAG_PART = r"#?[A-Za-z0-9_'\-]+", "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: What generated translations echo.
ECHOES = (r"(?s)^.*?\bassistant\b\s*", r"(?i)^(english|en|translation|traduction|übersetzung)\s*:\s*", r"(?s)^.*?nothing else\.\s*")
#: Organisation and venue words of the cue score, in their case.
CUE_WORDS = (
    "University College Institute Institutes Hospital Hospitals Center Centre Centers Centres Foundation Association Society School Schools Department "
    "Departments Laboratory Laboratories Lab Labs Clinic Clinics Agency Ministry Office Council Academy Administration Commission Committee Consortium Trial "
    "Group Network Project Programme Program Oxford Harvard Stanford Cambridge Yale MIT Imperial Johns Hopkins Mayo Cleveland Karolinska Lancet Nature "
    "Science JAMA BMJ NEJM CDC FDA NIH WHO NHS OECD UNICEF UNESCO"
)
#: Title-case words that aren't names.
CUE_STOP = tuple(
    "A An The This That These Those While With Without For From Into Onto Over Under Of In On At To And Or But If It Its They We Our Their There Here What "
    "Why How When Where Not No Yes Fact Study Studies Results Finding Findings Background Objective Methods Conclusion Conclusions Evidence Report Research "
    "Open Access Significant Recent New First".split()
)
#: Patterns of the cue score.
CUE_WORD = rf"\b(?:{CUE_WORDS.replace(' ', '|')})\b"
CUE_CITED = r"\b[A-Z][a-z]+\s+et\s+al\b|\bby\s+[A-Z][a-z]+|\bfrom\s+[A-Z][a-z]+"
CUE_ACRONYM = r"\b[A-Z]{2,}(?:[-/]?[0-9]+)?\b|\b[A-Z]\.[A-Z](?:\.)?\b"
CUE_TOKEN = r"[@#]?[A-Za-z][A-Za-z0-9.'\-]*"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stop_array(words: tuple[str, ...] = STOP_EN) -> Column:
    return F.array(*[F.lit(w) for w in words])


def normalize_ws(x: str | Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"[\s\x{00A0}]+", " "))


def clean_keep_handles(x: str | Column) -> Column:
    """Symbols of handles and tags dropped, their words kept; emoji dropped."""
    y = F.regexp_replace(F.regexp_replace(_c(x), MENTION, "$1$2"), HASHTAG, "$1$2")
    return normalize_ws(F.regexp_replace(y, EMOJI, ""))


def clean_drop_handles(x: str | Column) -> Column:
    """Links and handles dropped, tags as words, emoji dropped."""
    y = F.regexp_replace(F.regexp_replace(_c(x), URL, ""), MENTION, "$1")
    return normalize_ws(F.regexp_replace(F.regexp_replace(y, HASHTAG, "$1$2"), EMOJI, ""))


def clean_mask_handles(x: str | Column) -> Column:
    """As ``clean_drop_handles`` with handles masked as ``@user``."""
    y = F.regexp_replace(F.regexp_replace(_c(x), URL, ""), MENTION, "$1@user")
    return normalize_ws(F.regexp_replace(F.regexp_replace(y, HASHTAG, "$1$2"), EMOJI, ""))


def clean_entities(x: str | Column, mask: bool = False) -> Column:
    """Links dropped, tags as words, five HTML entities decoded, symbols of classes So, Sk and Cs dropped; handles kept or masked."""
    y = F.regexp_replace(F.regexp_replace(_c(x), URL, ""), HASHTAG, "$1$2")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = F.replace(y, F.lit(entity), F.lit(sign))
    y = F.regexp_replace(y, r"[\p{So}\p{Sk}\p{Cs}]", "")
    return normalize_ws(F.regexp_replace(y, MENTION, "$1@user") if mask else y)


def ascii_fold(x: str | Column) -> Column:
    """Latin letters, ligatures and wide forms as their ASCII base, other non-ASCII characters dropped."""
    y = F.translate(_c(x), ACCENTS, PLAIN)
    for sign, base in LIGATURES.items():
        y = F.replace(y, F.lit(sign), F.lit(base))
    return F.regexp_replace(y, r"[^\x00-\x7F]", "")


def _kept(tokens: Column, least: int, stop: Column | None) -> Column:
    kept = F.filter(tokens, lambda t: F.length(t) >= least)
    return kept if stop is None else F.filter(kept, lambda t: ~F.array_contains(stop, t))


def tokenize_expansion(x: str | Column, stop: Column | None = None) -> Column:
    """Expansion terms: lower, handles dropped, tags as words, folded, possessive cut, stop words and short words out."""
    y = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), MENTION, "$1"), HASHTAG, "$1$2")
    tokens = F.regexp_extract_all(ascii_fold(y), F.lit(r"[a-z0-9_]+(?:'[a-z0-9_]+)?"), F.lit(0))
    cut = F.transform(tokens, lambda t: F.regexp_replace(t, r"'s$", ""))
    return _kept(cut, 3, stop_array() if stop is None else stop)


def tokenize_sparse(x: str | Column, stop: Column | None = None) -> Column:
    """Index terms: links, handles and # out, lower, ``[a-z0-9-]+``, stop words out."""
    y = F.regexp_replace(F.regexp_replace(_c(x), URL, " "), MENTION, "$1 ")
    tokens = F.regexp_extract_all(F.lower(F.replace(y, F.lit("#"), F.lit(""))), F.lit(r"[a-z0-9\-]+"), F.lit(0))
    return _kept(tokens, 1, stop_array() if stop is None else stop)


def tokenize_multi(x: str | Column, stop: Column | None = None) -> Column:
    """Latin-script words with inner apostrophes or hyphens, lower, possessive cut, at least three characters."""
    tokens = F.transform(F.regexp_extract_all(_c(x), F.lit(LATIN_TOKEN), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), r"['’]s$", ""))
    return _kept(tokens, 3, stop_array() if stop is None else stop)


def tokenize_w2v(x: str | Column) -> Column:
    """Training words: reference marks, names of reference services and links out, lower, other signs as blanks."""
    y = F.lower(F.regexp_replace(F.regexp_replace(_c(x), REFERENCES, " "), LINK, ""))
    return F.filter(F.split(F.regexp_replace(y, r"[^a-z0-9\-]+", " "), " "), lambda t: t != "")


def analyze(x: str | Column, stop: Column | None = None, drop_social: bool = False) -> Column:
    """Analyzer chain: words, leading # off, folded, lower, possessive cut, stop words out; optionally links, handles and # first."""
    y = _c(x)
    if drop_social:
        y = F.replace(F.regexp_replace(F.regexp_replace(y, URL, " "), MENTION, "$1 "), F.lit("#"), F.lit(" "))
    tokens = F.regexp_extract_all(F.lower(ascii_fold(y)), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)*"), F.lit(0))
    return _kept(F.transform(tokens, lambda t: F.regexp_replace(t, r"'s$", "")), 1, stop_array() if stop is None else stop)


def word_delimiter(token: str | Column) -> Column:
    """A token and its parts at signs, case changes and borders between letters and digits."""
    t = _c(token)
    parts = F.regexp_extract_all(t, F.lit(r"[A-Z]+[a-z]*|[a-z]+|[0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array(t), parts))


def vocabulary_words(x: str | Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))


def split_hashtags(x: str | Column) -> Column:
    """Camel-case tags as separate words."""
    return normalize_ws(F.regexp_replace(F.regexp_replace(_c(x), HASHTAG, "$1 $2 "), r"([a-z0-9])([A-Z])", "$1 $2"))


def clean_translation(x: str | Column) -> Column:
    """A generated translation without an echoed conversation before the assistant's mark, a label, or the instruction; blank lines out."""
    y = F.regexp_replace(_c(x), ENDS, "")
    for pattern in ECHOES:
        y = F.regexp_replace(F.regexp_replace(y, pattern, ""), ENDS, "")
    return F.regexp_replace(F.regexp_replace(y, r"\n(\s*\n)+", "\n"), ENDS, "")


def venue_filter(x: str | Column) -> Column:
    """Value of the first ``venue:`` clause, lower; null without one."""
    found = F.lower(F.regexp_extract(_c(x), r"venue:([^\s]+)", 1))
    return F.when(found != "", found)


def author_filter(x: str | Column) -> Column:
    """Value of an ``author:`` clause, which runs to the end; null without one."""
    found = F.lower(F.trim(F.regexp_extract(_c(x), r"author:(.+)$", 1)))
    return F.when(found != "", found)


def term_variants(term: str | Column, lang: str = "en") -> Column:
    """Lower form, form without hyphens and singular guesses."""
    t = F.lower(_c(term))
    bare = F.replace(t, F.lit("-"), F.lit(" "))
    if lang == "en":
        single = (
            F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(F.substr(t, F.lit(1), F.length(t) - 3), F.lit("y")))
            .when((F.length(t) > 4) & t.endswith("es"), F.substr(t, F.lit(1), F.length(t) - 2))
            .when((F.length(t) > 4) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1))
            .otherwise(t)
        )
    else:
        single = F.when((F.length(t) > 4) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.array(t, bare, single))


def social_terms(x: str | Column, emoji: dict[str, str], slang: dict[str, str], stop: Column | None = None) -> Column:
    """Terms of a post: emoji as the words a table gives, hashtags split at case changes, digits and underscores, slang replaced, stop words and single letters out."""
    y = _c(x)
    for sign, name in emoji.items():
        y = F.replace(y, F.lit(sign), F.lit(f" {name} "))
    tokens = F.regexp_extract_all(y, F.lit(SOCIAL_TOKEN), F.lit(0))
    split = F.flatten(F.transform(tokens, lambda t: F.when(t.startswith("#"), F.transform(F.regexp_extract_all(t, F.lit(TAG_PART), F.lit(0)), F.lower)).otherwise(F.array(t))))
    table = F.create_map(*[F.lit(v) for pair in slang.items() for v in pair])
    plain = F.transform(split, lambda t: F.coalesce(table[F.lower(t)], t))
    words = stop_array() if stop is None else stop
    return F.filter(plain, lambda t: (F.length(t) > 1) & ~F.array_contains(words, F.lower(t)))


def rule_views(rows: DataFrame, sentences: dict[str, tuple[str, str, str]]) -> DataFrame:
    """``qid, lang, keywords, sparse, embedding, colbert, expanded`` of ``qid, lang, plain``, query terms ``q`` and document terms ``dd``."""
    some = lambda c: F.when(c != "", c)
    joined = lambda a, sign: F.array_join(a, sign)
    plain, q, dd = F.col("plain"), F.col("q"), F.col("dd")
    parts = [F.coalesce(*[F.when(F.col("lang") == k, F.lit(v[i])) for k, v in sentences.items()]) for i in range(3)]
    variants = F.when(F.col("lang") == "en", F.flatten(F.transform(q, lambda t: term_variants(t)))).otherwise(F.flatten(F.transform(q, lambda t: term_variants(t, "other"))))
    context = F.when(F.size(dd) > 0, F.concat(parts[1], joined(F.slice(dd, 1, 8), ", "))).otherwise("")
    views = rows.select(
        "qid", "lang",
        F.coalesce(some(joined(q, "; ")), plain).alias("keywords"),
        F.coalesce(some(joined(F.array_distinct(F.concat(variants, F.slice(dd, 1, 18))), " ; ")), plain).alias("sparse"),
        normalize_ws(F.concat(parts[0], F.coalesce(some(joined(F.slice(q, 1, 8), ", ")), plain), context, parts[2])).alias("embedding"),
        F.coalesce(some(F.concat_ws(" ; ", some(plain), some(joined(F.array_distinct(F.concat(q, F.slice(dd, 1, 10))), " ")))), plain).alias("colbert"),
    )
    merged = F.concat("keywords", F.lit(". "), "embedding", F.lit(" Lexical hints: "), "sparse", F.lit(". Token hints: "), "colbert", F.lit("."))
    return views.withColumn("expanded", normalize_ws(merged))


def salient_terms(tokens: str | Column, n: int) -> Column:
    """First n distinct terms: those with a digit or hyphen, acronyms, capitalised or longer than five first."""
    distinct = F.array_distinct(_c(tokens))

    def telling(t: Column) -> Column:
        return t.rlike(r"[0-9\-]") | t.rlike(r"^[A-Z]") | (F.length(t) > 5)

    return F.slice(F.concat(F.filter(distinct, telling), F.filter(distinct, lambda t: ~telling(t))), 1, n)


def entity_cue_score(x: str | Column) -> Column:
    """Cues of named sources: 2 for each organisation or venue word that occurs, 2 for "X et al / by X / from X", 1 for each acronym but RT, 1 for each title-case
    token but the first, 2 for each pair of neighbouring ones."""
    t = _c(x)
    words = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(CUE_WORD), F.lit(0))))
    cited = t.rlike(CUE_CITED).cast("int")
    acronyms = F.size(F.filter(F.regexp_extract_all(t, F.lit(CUE_ACRONYM), F.lit(0)), lambda w: w != "RT"))
    tokens = F.transform(F.regexp_extract_all(t, F.lit(CUE_TOKEN), F.lit(0)), lambda w: F.regexp_replace(w, "^[@#]", ""))
    stop = stop_array(CUE_STOP)
    titled = F.transform(tokens, lambda w: (w.rlike("^[A-Z]") & (w != F.upper(w)) & ~F.array_contains(stop, w)))
    long = F.size(F.filter(F.zip_with(titled, tokens, lambda a, w: a & (F.length(w) > 2)), lambda v: v)) - F.coalesce((F.get(titled, F.lit(0)) & (F.length(F.get(tokens, F.lit(0))) > 2)).cast("int"), F.lit(0))
    pairs = F.size(F.filter(F.zip_with(titled, F.slice(titled, 2, 1_000_000), lambda a, b: a & b), lambda v: v))
    return 2 * words + 2 * cited + acronyms + long + 2 * pairs


def doc_text(title: str = "title", abstract: str = "abstract", authors: str = "authors", kind: str = "plain") -> Column:
    """Document text; kinds: plain, labelled (``title. abstract Authors: ...``), authored, dotted."""
    def some(c: str) -> Column:
        v = normalize_ws(F.coalesce(F.col(c), F.lit("")))
        return F.when(v != "", v)

    if kind == "plain":
        return F.concat_ws(" ", some(title), some(abstract))
    if kind == "labelled":
        return F.concat_ws(" ", F.concat_ws(". ", some(title), some(abstract)), F.concat(F.lit("Authors: "), some(authors)))
    if kind == "authored":
        return F.concat_ws(" ", some(title), some(abstract), F.concat(F.lit("Authors: "), some(authors)))
    if kind == "dotted":
        both = F.concat(F.coalesce(some(title), F.lit("")), F.lit(". "), F.coalesce(some(abstract), F.lit("")))
        return F.regexp_replace(both, r"^[. ]+|[. ]+$", "")
    raise ValueError(f"unknown kind {kind}")


def whole_number(x: str | Column) -> Column:
    """Integer of a text of digits with an optional sign; null for anything else."""
    t = F.trim(_c(x))
    return F.when(t.rlike(r"^-?[0-9]{1,18}$"), t.try_cast("bigint"))
