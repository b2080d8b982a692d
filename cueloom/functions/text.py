"""Scalar text functions as Column expressions (JVM side unless noted)."""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Sentence ends, closers, dropped punctuation and limits of the subtitle rules.
SENTENCE_END = "。？！?!"
CLOSERS = "」』）)”’"
DROPPED = "。，；："
REPEAT_THRESHOLD = 2.4
SMALL_KANA = "っぁぃぅぇぉゃゅょゎゕゖ"
LARGE_KANA = "つあいうえおやゆよわかけ"
KANA_NOISE = r"[\s、。，,！!?？「」『』・…\-—.·()（）:：;；]"
SPEECH_DECORATION = r"[♪♡♠★☆ｗＷwW・＝=]"
NON_LEXICAL = r"[^\p{L}\p{N}]"
# Unicode white space spelled out: far cheaper per character than the (?U) flag.
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at both ends; a pattern would be tried at every space of the text."""
    return F.btrim(text, F.lit(SPACES))


def lexical(text: Column) -> Column:
    return F.regexp_replace(text, NON_LEXICAL, "")


def lexical_count(text: Column) -> Column:
    return F.length(lexical(text)).cast("bigint")


def visible_length(text: Column) -> Column:
    return F.length(strip(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compact(text: Column, *, normalise: bool = True) -> Column:
    """Lower-case letters, digits and the long-vowel mark."""
    base = nfkc(text) if normalise else text
    return F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}ー]", "")


def kana_reading(text: Column) -> Column:
    """Reading normal form once dictionary readings are in place."""
    bare = F.regexp_replace(F.lower(text), KANA_NOISE, "")
    return F.translate(F.replace(bare, F.lit("ー"), F.lit("")), SMALL_KANA, LARGE_KANA)


def match_reading(text: Column) -> Column:
    return F.regexp_replace(kana_reading(text), SPEECH_DECORATION, "")


def suspicious(text: Column) -> Column:
    """A 2-12 character unit repeated four times running, or a credit line."""
    return text.rlike(r"(?s)(?:(.{2,12})\1{3,})|作詞.{0,15}作曲|ご視聴.{0,8}ありがとう")


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    def ratio(value: str | None) -> float | None:
        if value is None:
            return None
        data = value.encode("utf-8")
        return len(data) / len(zlib.compress(data))

    return text.map(ratio)


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def negations_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(ません|ない|無い|なかった|なければ|なく|ずに)"), F.lit(1))


def collapse(text: Column) -> Column:
    """One physical line: runs of white space become one space."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def convention(text: Column) -> Column:
    """Subtitle punctuation: dropped next to an ellipsis, a space elsewhere."""
    near = F.regexp_replace(text, f"[{DROPPED}]+(?=…)|(?<=…)[{DROPPED}]+", "")
    kept = F.when(text.contains("…"), near).otherwise(text)
    return collapse(F.translate(kept, DROPPED, " " * len(DROPPED)))


def preserved(original: Column, final: Column) -> Column:
    gone = DROPPED + SPACES
    return F.translate(original, gone, "") == F.translate(final, gone, "")


def clip(text: Column, limit: int) -> Column:
    bare = strip(text)
    return F.when(F.length(bare) <= limit, bare).otherwise(
        F.concat(F.substring(bare, 1, limit - 1), F.lit("…"))
    )


def quote_pattern(span: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, span: Column) -> Column:
    """Occurrences of a literal, overlapping ones included."""
    found = F.regexp_count(text, F.concat(F.lit("(?s)(?="), quote_pattern(span), F.lit(")")))
    return F.when(F.length(span) == 0, 0).otherwise(found).cast("bigint")


def unique_span(text: Column, span: Column) -> Column:
    return occurrences(text, span) == 1


def span_rejection(text: Column, span: Column) -> Column:
    size, whole = F.length(span), F.length(text)
    return F.when(size > 160, "target_span_over_160_codepoints").when(
        (whole > 100) & (size * 5 > whole * 3), "target_span_over_60_percent"
    )


def sample_thirds(text: Column, budget: int) -> Column:
    """Head, middle and tail thirds when the text is over budget."""
    third = budget // 3
    size = F.length(text)
    return F.when(size <= budget, text).otherwise(
        F.concat(
            F.substring(text, 1, third),
            F.lit("\n...[中略]...\n"),
            text.substr(F.floor((size - third) / 2).cast("int") + 1, F.lit(third)),
            F.lit("\n...[后略]...\n"),
            F.right(text, F.lit(third)),
        )
    )


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


# Batch prefixes, meaningless stems and generic words of media titles.
TITLE_PREFIXES = (
    r"^\s*(?:\[[^\]]*\]|【[^】]*】|（[^）]*）|\([^)]*\))\s*",
    r"^\d{1,4}\s*[._\-—:\s]*",
    r"(?i)^(?:track|audio|file|chap(?:ter)?|part|clip|movie|video|ep(?:isode)?|配信|録音|音声)\s*[\d._\-:\s]*",
    r"^\s+",
)
TITLE_MEANINGLESS = r"(?i)^[\d\s._\-—:()\[\]【】（）]+$|^[a-z0-9]{1,3}$|^(?:track|audio|file)$"
TITLE_GENERIC = (
    "main", "sample", "test", "demo", "preview", "clip", "temp", "test1", "rec", "recording", "new",
    "untitled", "audio", "sound", "voice",
)


def clean_title(stem: Column, rounds: int = 4) -> Column:
    """Strip batch naming.  One alternation repeated covers every order the prefixes come in."""
    union = "|".join(p.replace("(?i)", "").lstrip("^") for p in TITLE_PREFIXES)
    return strip(F.regexp_replace(strip(stem), rf"(?iU)^(?:{union})+", ""))


def meaningful_title(title: Column) -> Column:
    bare = strip(title)
    content = (
        bare.rlike(r"[\x{3040}-\x{30ff}]")
        | (F.regexp_count(bare, F.lit(r"[\x{4e00}-\x{9fff}]")) >= 2)
        | bare.rlike("[A-Za-z]{2,}")
    )
    return (
        (F.length(bare) >= 2) & ~bare.rlike(TITLE_MEANINGLESS)
        & ~F.lower(bare).isin(*TITLE_GENERIC) & content
    )


# Stage-direction lines and speaker prefixes of scripts.
STAGE_ONLY = r"^\s*[（(【〔].{0,40}[）)】〕]\s*$"
SPEAKER = r"^\s*([^\s：:]{1,15})\s*[：:]\s*"


def script_sentences(text: Column) -> Column:
    """Spoken sentences of a script: no stage lines, no speaker names."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), strip), lambda s: (s != "") & ~s.rlike(STAGE_ONLY))
    spoken = F.transform(lines, lambda s: F.regexp_replace(s, SPEAKER, ""))
    parts = F.flatten(
        F.transform(spoken, lambda s: F.split(s, r"(?<=[。！？!?…])(?![。！？!?…])"))
    )
    bare = F.transform(parts, strip)
    return F.filter(bare, lambda s: (s != "") & ~s.rlike(STAGE_ONLY))


TERMINATOR = rf"(?:…*[{SENTENCE_END}]+|…+(?![{SENTENCE_END}]))[{CLOSERS}]*"


def sentences(text: Column) -> Column:
    """Split after terminators; pieces without a letter or digit stay with a neighbour.

    A terminator run only ends a piece that already holds a lexical character; a tail
    without one joins the last piece.
    """
    piece = rf"(?sU)(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}].*?(?:{TERMINATOR}|\z)(?:[^\p{{L}}\p{{N}}]+\z)?)|(?:.+)"
    return F.regexp_extract_all(text, F.lit(f"({piece})"), F.lit(1))


def latin_residue(text: Column) -> Column:
    return text.rlike("[A-Za-z]{3,}") & ~text.rlike(r"[\x{3040}-\x{30ff}]")


def kana_residue(text: Column) -> Column:
    return text.rlike(r"[\x{3040}-\x{30ff}]")


# Answers that mean "no change" and the shapes of meta commentary.
META_EXACT = (
    "无需修改", "无须修改", "不需要修改", "无需更改", "无改动", "不修改", "正确", "无误", "没有问题", "无问题", "保持原样", "保持不变", "保持原译", "维持原样",
    "存疑", "同上", "无",
)
META_EDGE = "[ \\t。．.!！?？，,、；;：:\"'“”‘’()（）]"
META_PREFIX = (
    r"^\s*(?:该行|此行|本行|这一行|这行|原译|原文)?\s*(?:译文|翻译)?\s*(?:已经|已|完全)?\s*"
    r"(?:无需修改|无须修改|不需要修改|无需更改|不修改|正确|无误|没有问题|"
    r"无问题|保持原样|保持不变|保持原译|维持原样)"
)
META_GRAMMAR = r"^\s*\[?\s*\d*\s*\]?\s*(?:修改|存疑)\s*[|｜:：]"


def meta_answer(value: Column) -> Column:
    bare = F.regexp_replace(strip(value), f"^{META_EDGE}+|{META_EDGE}+$", "")
    return bare.isin(*META_EXACT) | value.rlike(META_PREFIX) | value.rlike(META_GRAMMAR)


def fix_rejection(value: Column, old: Column, source: Column) -> Column:
    """Why a replacement line is refused; null when it is safe to apply."""
    from_source = visible_length(source)
    ref = F.when(from_source > 0, from_source).otherwise(visible_length(old))
    size = visible_length(value)
    # Lower bound max(1, min(0.2 n, n - 8)), compared in fifths to stay in integers.
    low5 = F.greatest(F.lit(5), F.least(ref, (ref - 8) * 5))
    return (
        F.when(value == "", "empty")
        .when(meta_answer(value), "meta")
        .when(ref == 0, None)
        .when(size > F.greatest(ref * 3, F.lit(20)), "too_long")
        .when(ref <= 3, None)
        .when(size * 5 < low5, "too_short")
    )


def han_only(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}])"), F.lit(1)), "")


def forbidden_reasons(text: Column, source: Column) -> Column:
    """Every rule an edited text breaks, as an array of names."""
    flat = strip(text)
    return F.array_compact(
        F.array(
            F.when(flat == "", "empty"),
            F.when(text.rlike(r"\n\s*\n"), "blank_line"),
            F.when(text.rlike(r"\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}"), "timestamp"),
            F.when(text.rlike(r"(?i)</?think(?:ing)?>"), "reasoning"),
            F.when(text.contains("```") | text.rlike("[⟦⟧]"), "marker"),
            F.when(text.rlike(r"[\p{Cc}\p{Cf}&&[^\n]]"), "control"),
            F.when(F.length(flat) > F.greatest(F.lit(160), F.length(source) * 4), "runaway"),
        )
    )


def anchored(old_text: Column, old: Column, new: Column, witness: Column) -> Column:
    """Does the witness hold ``new`` between neighbours of ``old``?

    The left and right neighbours are the four characters either side of ``old``; each must
    be absent or occur within 24 characters of some place of ``new``, and at least one must
    be two characters or longer.
    """
    at = F.instr(old_text, old)
    left = old_text.substr(F.greatest(F.lit(1), at - 4), F.least(F.lit(4), at - 1))
    right = old_text.substr(at + F.length(old), F.lit(4))
    spots = F.filter(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(witness))),
        lambda p: witness.substr(p, F.length(new)) == new,
    )

    def holds(p: Column) -> Column:
        before = witness.substr(F.greatest(F.lit(1), p - 24), F.least(F.lit(24), p - 1))
        after = witness.substr(p + F.length(new), F.lit(24))
        return ((left == "") | before.contains(left)) & ((right == "") | after.contains(right))

    return ((F.length(left) >= 2) | (F.length(right) >= 2)) & F.exists(spots, holds)
