"""Text detection as column expressions: one regular-expression engine finds families, counts, matches and offsets."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.lexicons import lexicon

# Case-insensitive, Unicode classes, and only "\n" ends a line: Python's str patterns under Java.
FLAGS = "(?iUd)"
# --- fixed values: sentence boundaries, note delimiter ---
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
NOTE_DELIM = "\n\n---\nProvenance note:"
# --- end of fixed values ---


def as_col(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value, fn) -> Column:
    """fn(value) with the value computed once per row.

    An expression mentioned inside a lambda is evaluated for every element; bound as a lambda variable
    of its own it is not.
    """
    return F.get(F.transform(F.array(as_col(value)), fn), F.lit(0))


def has(text, pattern: str) -> Column:
    return F.coalesce(as_col(text).rlike(FLAGS + pattern), F.lit(False))


# ---------------------------------------------------------------- literals of patterns

#: What else than its two cases matches an ASCII letter when case is ignored the Unicode way.
ODD_CASES = "\u017f\u0131\u0130\u212a"
#: A piece of a pattern as far as its literals go: escapes, classes, groups, quantifiers, single characters.
_PIECE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?(?:[:=!]|<[=!])|[*+?]\??|\{[^}]*\}\??|.", re.S)


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII literals of which every match of the pattern holds one at least; empty where none are known.

    Reads plain sequences, groups and alternatives; anything else (flags, back references, anchors of lines) counts as unknown.
    """
    pieces = _PIECE.findall(pattern)

    def branch(at: int) -> tuple[tuple[str, ...], int]:
        """The best literals of the alternatives from a position to the end of their group."""
        found: list[tuple[str, ...]] = []
        best: tuple[str, ...] = ()
        run = ""

        def better(a, b):
            return a if a and (not b or min(map(len, a)) > min(map(len, b))) else b
        while True:
            piece = pieces[at] if at < len(pieces) else ")"
            last: tuple[str, ...] = ()
            single = False
            if piece in ("|", ")"):
                found.append(better((run,) if run else (), best))
                if piece == ")":
                    return (tuple(dict.fromkeys(x for f in found for x in f)) if all(found) else ()), at + 1
                best, run, at = (), "", at + 1
                continue
            if piece == "(" or piece.startswith("(?"):
                ahead = piece not in ("(", "(?:")
                last, at = branch(at + 1)
                last = () if ahead else last
            else:
                single = piece.isascii() and (piece.isalnum() or piece in " -:/,;%&'_")
                last, at = ((piece.lower(),) if single else ()), at + 1
            follow = pieces[at] if at < len(pieces) else ""
            quantified = follow[:1] in ("*", "+", "?", "{") and follow != ""
            least = quantified and (follow[0] == "+" or follow[0] == "{" and not follow.startswith(("{0", "{,")))
            if quantified:
                at += 1
            if single and not quantified:
                run += last[0]
                continue
            # whatever ends a run of literals: a wider piece, a group or a quantified character
            if single and least:
                run += last[0]
            best, run = better((run,) if run else (), best), ""
            if not quantified or least:
                best = better(last, best)

    if "(?" in re.sub(r"\(\?(?:[:=!]|<[=!])", "", pattern) or re.search(r"\\[1-9kQExuNpP0c]", pattern):
        return ()
    lits = branch(0)[0]
    return lits if lits and min(map(len, lits)) > 1 else ()


def _folded(text) -> Column:
    """What `_maybe` reads: the text, its lower case, whether it is ASCII, and whether it has letters that case folding takes for
    ASCII ones."""
    def known(e):
        odd = reduce(lambda a, b: a | b, [F.contains(e["t"], F.lit(c)) for c in ODD_CASES])
        return F.struct(e["t"].alias("t"), F.lower(e["t"]).alias("l"), e["a"].alias("a"), (~e["a"] & odd).alias("o"))
    return let(F.struct(as_col(text).alias("t"), _ascii(text).alias("a")), known)


def _ascii(text) -> Column:
    return F.octet_length(as_col(text)) == F.length(as_col(text))


def _lengths(texts, ascii_: Column) -> Column:
    """Characters of each text; where all are ASCII they aren't counted one by one."""
    return F.when(ascii_, F.transform(texts, lambda x: F.octet_length(x))).otherwise(F.transform(texts, lambda x: F.length(x)))


def _maybe(e: Column, pattern: str) -> Column | None:
    """Whether a folded text may match: it holds a literal that every match holds. None where the pattern has no such literal."""
    lits = needed(pattern)
    return reduce(lambda a, b: a | b, [e["o"], *[F.contains(e["l"], F.lit(x)) for x in lits]]) if lits else None


def _has_folded(e: Column, pattern: str) -> Column:
    maybe = _maybe(e, pattern)
    found = has(e["t"], led(pattern))
    return found if maybe is None else F.coalesce(maybe, F.lit(False)) & found


#: The letters that ODD_CASES stand for.
_FOLDS = dict(zip(ODD_CASES, "siik"))


@lru_cache(maxsize=None)
def led(pattern: str) -> str:
    """A pattern that begins with a word boundary and a letter, with the letter looked for before the boundary; it matches the same.

    At nearly every character of a text the letter is not there, and a boundary is dearer to tell.
    """
    start = re.match(r"\\b([a-z])(?![*?+{])", pattern, re.I)
    alone = re.sub(r"\([^()]*\)", "", re.sub(r"\[\^?\]?[^\]]*\]", "", re.sub(r"\\.", "", pattern)))
    if start is None or "|" in alone or re.search(r"\(\?[a-z-]|\\Q", pattern, re.I):
        return pattern
    first = start[1].lower()
    both = f"[{first}{first.upper()}{''.join(c for c in ODD_CASES if _FOLDS[c] == first)}]"
    return rf"(?-i:{both}(?<=\b{both})){pattern[start.end():]}"


#: FLAGS for ASCII texts, where Unicode classes and case folding tell the same and cost more.
ASCII_FLAGS = "(?id)"
_PLAIN = re.compile(r"(?:[\x00-\x5b\x5d-\x7f]|\\[bBdDsSwW]|\\[^a-zA-Z0-9])*")


@lru_cache(maxsize=None)
def ascii_alike(pattern: str) -> bool:
    """Whether a pattern finds the same in an ASCII text under ASCII_FLAGS."""
    return pattern.isascii() and bool(_PLAIN.fullmatch(pattern)) and not re.search(r"\(\?[a-zA-Z-]", pattern)


def flagged(pattern: str, ascii_: Column) -> Column:
    """The pattern with its flags, for a text that is ASCII or not."""
    full = F.lit(FLAGS + led(pattern))
    return F.when(ascii_, F.lit(ASCII_FLAGS + led(pattern))).otherwise(full) if ascii_alike(pattern) else full


@lru_cache(maxsize=None)
def width(pattern: str) -> int | None:
    """Characters of every match of a pattern of letters, classes of letters and word boundaries; None for any other."""
    plain = re.fullmatch(r"(?:\\b|[a-z0-9 ]|\[[a-z0-9]+\])+", pattern, re.I)
    return len(re.sub(r"\[[^\]]*\]", "x", pattern.replace(r"\b", ""))) or None if plain else None


# ---------------------------------------------------------------- families

def families_mask(text, lex) -> Column:
    """Bit i is set when family i of the lexicon has at least one match. Null text gives 0.

    A pattern is searched for in texts that hold one of its literals.
    """
    def bits(e):
        return reduce(lambda a, b: a.bitwiseOR(b), [
            F.when(reduce(lambda a, b: a | b, [_has_folded(e, p) for p in pats]), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for i, pats in enumerate(lexicon(lex).values())])
    return let(_folded(text), bits)


def mask_names(mask, lex) -> Column:
    """Sorted family names of a mask."""
    order = sorted((name, i) for i, name in enumerate(lexicon(lex)))
    return let(mask, lambda m: F.array_compact(F.array(*[
        F.when(m.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(name)) for name, i in order
    ])))


def mask_has(mask, i: int) -> Column:
    return as_col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def mask_minus(a, b) -> Column:
    """Bits of a not in b."""
    return as_col(a).bitwiseAND(F.bitwise_not(as_col(b)))


def families(text, lex) -> Column:
    """Sorted array of the families present."""
    return mask_names(families_mask(text, lex), lex)


def pattern_count(text, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(as_col(text), F.lit(FLAGS + pattern)), F.lit(0))


def family_counts(text, lex) -> dict[str, Column]:
    """Matches per family, summed pattern by pattern (overlaps between patterns count twice)."""
    return {
        fam: reduce(lambda a, b: a + b, [pattern_count(text, p) for p in pats])
        for fam, pats in lexicon(lex).items()
    }


def total_count(text, lex) -> Column:
    return reduce(lambda a, b: a + b, family_counts(text, lex).values())


def family_matches(text, lex, limit: int = 5, mask=None) -> Column:
    """Map family -> its first matched strings in pattern order; families without a match are absent.

    With a mask column only the families of the mask are looked up at all.
    """
    entries = []
    for i, (fam, pats) in enumerate(lexicon(lex).items()):
        parts = [F.regexp_extract_all(as_col(text), F.lit(FLAGS + p), F.lit(0)) for p in pats]
        hit = F.struct(F.lit(fam).alias("k"), F.slice(F.flatten(F.array(*parts)), 1, limit).alias("v"))
        entries.append(F.when(mask_has(mask, i), hit) if mask is not None else hit)
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull() & (F.size(e["v"]) > 0)))


def running_lengths(lengths: Column, block: int = 32) -> Column:
    """Sum of the elements in front of each element of an int array.

    Appending to an array copies it, so sums run inside blocks and over block totals.
    """
    def grow(values, start):
        return F.aggregate(values, F.array(start), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))

    def over(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        each = F.zip_with(blocks, F.slice(grow(totals, F.lit(0)), F.lit(1), F.size(blocks)), lambda b, at: F.slice(grow(b, at), F.lit(1), F.size(b)))
        return F.flatten(each)

    def split(ls):
        starts = F.sequence(F.lit(1), F.size(ls), F.lit(block))
        return F.when(F.size(ls) > 0, F.transform(starts, lambda i: F.slice(ls, i, F.lit(block)))).otherwise(F.array().cast("array<array<int>>"))

    def short(ls):
        return F.when(F.size(ls) <= block, F.slice(grow(ls, F.lit(0)), F.lit(1), F.size(ls))).otherwise(let(split(ls), over))
    return let(lengths, short)


def _stretches(text, pattern, matches: Column, ascii_: Column) -> Column:
    """Lengths of the matches (`m`), of the gaps around them (`g`, one more), and where each gap starts (`at`)."""
    gaps = _lengths(F.split(as_col(text), pattern, -1), ascii_)
    marks = _lengths(matches, ascii_)
    return let(F.struct(gaps.alias("g"), marks.alias("m")), lambda e: F.struct(
        e["g"].alias("g"), e["m"].alias("m"),
        running_lengths(F.zip_with(e["g"], e["m"], lambda g, m: g + F.coalesce(m, F.lit(0)))).alias("at")))


def spans(text, lex) -> Column:
    """Sorted (start, end, family) character offsets of every match; empty for a null text.

    What lies between matches and the matches themselves give the offsets by their lengths. A pattern is searched for in
    texts that hold one of its literals. Meant for patterns that match no empty string.
    """
    none = F.array().cast("array<struct<start:int,end:int,family:string>>")

    def located(e, fam, pattern):
        """One search where all matches are equally wide, two where their own lengths are needed."""
        wide, searched = width(pattern), flagged(pattern, e["a"])

        def span(start, length):
            return let(start, lambda at: F.struct(at.alias("start"), (at + length).alias("end"), F.lit(fam).alias("family")))
        if wide:
            def between(g):
                ends = running_lengths(F.transform(g, lambda x: x + F.lit(wide)))
                starts = let(ends, lambda at: F.transform(F.slice(g, F.lit(1), F.size(g) - 1), lambda x, i: span(F.get(at, i) + x, F.lit(wide))))
                return F.when(F.size(g) > 1, starts).otherwise(none)
            return let(_lengths(F.split(e["t"], searched, -1), e["a"]), between)

        def measured(matches):
            found = let(_stretches(e["t"], searched, matches, e["a"]), lambda s: F.transform(
                s["m"], lambda m, i: span(F.get(s["at"], i) + F.get(s["g"], i), m)))
            return F.when(F.size(matches) > 0, found).otherwise(none)
        return let(F.regexp_extract_all(e["t"], searched, F.lit(0)), measured)

    def every(e):
        def part(fam, pattern):
            maybe = _maybe(e, pattern)
            found = located(e, fam, pattern)
            return found if maybe is None else F.when(maybe, found).otherwise(none)
        return F.sort_array(F.flatten(F.array(*[part(fam, p) for fam, pats in lexicon(lex).items() for p in pats])))
    return let(_folded(text), every)


def held(df, name: str, value):
    """withColumn of a costly value that is computed once per row.

    A column that the optimizer may merge into later projections, lambda bodies or filters is evaluated again in each;
    the output of a generator is not.
    """
    return df.select("*", F.explode_outer(F.array(F.struct(value.alias("v")))).alias("_held")).withColumn(name, F.col("_held.v")).drop("_held")


# ---------------------------------------------------------------- sentences

def sentences(text, rule: str = "boundary") -> Column:
    """Array of sentences.

    boundary  after . ! ? and white space, or at line breaks; empty pieces dropped
    capital   additionally the next character is A-Z or 0-9; 20 to 600 characters
    judged    . ! ? then white space; 40 to 400 characters
    labelled  same break; 25 to 400 characters
    quoted    same break; more than 30 characters
    """
    t = as_col(text)
    if rule == "boundary":
        return F.filter(F.split(t, SENTENCE_BREAK, -1), lambda s: s != "")
    lo, hi, brk = {
        "capital": (20, 600, r"(?<=[.!?])\s+(?=[A-Z0-9])"),
        "judged": (40, 400, r"(?<=[.!?])\s+"),
        "labelled": (25, 400, r"(?<=[.!?])\s+"),
        "quoted": (31, None, r"(?<=[.!?])\s+"),
    }[rule]
    pieces = F.transform(F.split(t, brk, -1), strip)
    keep = (lambda s: F.length(s).between(lo, hi)) if hi else (lambda s: F.length(s) >= lo)
    return F.filter(pieces, keep)


def explode_rows(df, keep, array, pos: str = "pos", value: str = "value"):
    """posexplode of a costly array expression.

    The outer form with a filter on the position: a plain explode makes the optimizer infer a size filter
    and evaluate the whole expression a second time below any exchange.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def strip(text) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(as_col(text), r"(?U)^\s+|\s+$", "")


def sentence_offsets(text) -> Column:
    """Array of (start, end) of the boundary-rule sentences; empty for a null text."""
    # white space is looked for before what stands in front of it
    searched = r"(?=\s)(?:" + SENTENCE_BREAK + ")"

    def placed(e):
        # breaks of one character each, as their sum tells, aren't searched for themselves
        breaks = F.size(e["g"]) - 1
        single = F.aggregate(e["g"], F.lit(0), lambda a, x: a + x) + breaks == e["n"]
        marks = F.when(single, F.transform(e["g"], lambda _: F.lit(1))).otherwise(
            _lengths(F.regexp_extract_all(e["t"], F.lit(searched), F.lit(0)), e["a"]))
        starts = running_lengths(F.zip_with(e["g"], marks, lambda g, m: g + F.coalesce(m, F.lit(0))))
        return F.zip_with(starts, e["g"], lambda at, g: F.struct(at.alias("start"), (at + g).alias("end")))

    def parted(e):
        return F.struct(e["t"].alias("t"), e["n"].alias("n"), (e["n"] == F.octet_length(e["t"])).alias("a"))

    def gapped(e):
        return F.struct(e["t"].alias("t"), e["n"].alias("n"), e["a"].alias("a"), _lengths(F.split(e["t"], searched, -1), e["a"]).alias("g"))
    t = F.coalesce(as_col(text), F.lit(""))
    pieces = let(let(let(F.struct(t.alias("t"), F.length(t).alias("n")), parted), gapped), placed)
    return F.filter(pieces, lambda p: p["end"] > p["start"])


# ---------------------------------------------------------------- normalisers

def norm(text, rule: str = "space") -> Column:
    """Named normalisers; the variants differ on purpose and are never merged.

    space   collapse white space, trim
    markup  unify Unicode spaces, dashes, quotes and ellipses, drop markdown marks and <br>, lower, collapse
    amount  drop commas and dollar signs, en dash to hyphen, collapse, lower
    money   drop dollar signs and asterisks, collapse, lower
    digits  money, digit-group separators dropped and hyphens to blanks; ends are not trimmed
    word    lower, every non-word run to one blank
    """
    t = as_col(text)
    if rule == "markup":
        t = F.translate(t, "\u202f\u00a0\u2013\u2014\u2018\u2019\u201c\u201d", "  --''\"\"")
        t = F.lower(F.regexp_replace(F.replace(t, F.lit("\u2026"), F.lit("...")), r"[*_`#>]|<br\s*/?>", ""))
    elif rule == "amount":
        t = F.lower(F.translate(t, "\u2013,$", "-"))
    elif rule == "money":
        t = F.lower(F.translate(t, "$*", ""))
    elif rule == "digits":
        t = F.translate(F.lower(t), "-$*,\u202f\u00a0\u2009", " ")
        return F.regexp_replace(t, r"(?U)\s+", " ")
    elif rule == "word":
        return F.trim(F.regexp_replace(F.lower(t), r"(?U)\W+", " "))
    elif rule != "space":
        raise ValueError(rule)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def strip_note(text) -> Column:
    """Cut a trailing provenance note at its last delimiter."""
    t = as_col(text)
    tail = F.length(F.substring_index(t, NOTE_DELIM, -1))
    return F.when(F.instr(t, NOTE_DELIM) > 0,
                  F.substr(t, F.lit(1), F.length(t) - tail - F.lit(len(NOTE_DELIM)))).otherwise(t)


def strip_thinking(text, unopened: bool = True) -> Column:
    """Drop <think> blocks; with `unopened`, an opening-less closing tag also drops the head."""
    head = r"|\A.*?</think>" if unopened else ""
    return F.regexp_replace(as_col(text), r"(?s)<think>.*?</think>" + head, "")


def thinking(text) -> Column:
    """The contents of the <think> blocks."""
    return F.transform(F.regexp_extract_all(as_col(text), F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1)), strip)


def words(text) -> Column:
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(r"(?U)\w+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a token array, as joined strings."""
    last = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def answer_line(text) -> Column:
    """Text after the last 'ANSWER:' of a line; null when there is none."""
    hits = F.regexp_extract_all(as_col(text), F.lit(r"(?i)ANSWER:[ \t]*([^\n]*)"), F.lit(1))
    return F.when(F.size(hits) > 0, strip(F.element_at(hits, -1)))


# --- fixed values: figures and seat citations ---
FIGURE = r"\$?\d[\d,\.]+\s?(?:k|K|%|m|M|bn|million|billion)?"
CITATION = (r"\b(healthcare|clinical|medical|legal|financial|finance)\s+"
            r"(?:specialist|contribution|analysis|seat)\b[^.]*?\.")
# --- end of fixed values ---


def figures(text) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(FIGURE), F.lit(0))


def citations(text) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(FLAGS + CITATION), F.lit(0))


def content_overlap(a, b) -> Column:
    """Jaccard over capitalised tokens of at least three letters; 1 when neither side has any."""
    def caps(t):
        return F.array_distinct(F.regexp_extract_all(as_col(t), F.lit(r"(?U)\b[A-Z][A-Za-z]{2,}\b"), F.lit(0)))
    union = F.size(F.array_union(caps(a), caps(b)))
    return F.when(union > 0, F.size(F.array_intersect(caps(a), caps(b))) / union).otherwise(F.lit(1.0))
