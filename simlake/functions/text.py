"""Canonical text, checksums, tokens and shingles as column expressions; the regular expressions mean the same to Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import COMMON, RARE, REGISTERS, SIZES

COMMENT = r";[^\n]*"
WORD = r"[a-z0-9]+"
#: Strings, comments, preprocessor lines, numbers, names with an optional colon, operators.
ASM = "|".join((r'"[^"\n]*"', r"'[^'\n]*'", COMMENT, r"%[a-zA-Z_][^\n]*", r"#?-?0[xX][0-9a-fA-F]+", r"#?-?[0-9][0-9a-fA-F]*[hH]\b", r"#?-?[0-9]+(?:\.[0-9]+)?\b", r"[.$@?_A-Za-z][.$@?_A-Za-z0-9]*:?", r"[-+*/&|^~<>=!]+"))
NUMBER = r"^#?-?[0-9]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression used inside a lambda is otherwise computed again for each element."""
    return F.transform(F.array(value), body)[0]


def canonical_text(code: Column) -> Column:
    """Without comments, white space runs as one space, case kept; null where nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(code, COMMENT, " "), r"[ \t\r\n\f]+", " "))
    return F.when(F.length(text) > 0, text)


def checksum(code: Column, tokenizer: str = "asm") -> Column:
    """SHA-256 of the canonical text; a word text has no comments to drop."""
    text = canonical_text(code) if tokenizer == "asm" else canonical_words(code)
    return F.sha2(text.cast("binary"), 256)


def canonical_words(text: Column) -> Column:
    one = F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))
    return F.when(F.length(one) > 0, one)


def has_text(code: Column, tokenizer: str = "asm") -> Column:
    """Whether the canonical text is there, which the first of its characters tells."""
    return code.rlike(r"\A(?:[ \t\r\n\f]++|;[^\n]*+)*+[^ \t\r\n\f;]" if tokenizer == "asm" else r"[^ \t\r\n\f]")


def checksum_of_text(code: Column, tokenizer: str = "asm") -> Column:
    """checksum() where has_text(): each regular expression once, and only over what it changes."""
    plain = F.regexp_replace(code, COMMENT, " ") if tokenizer == "asm" else code
    return F.sha2(F.trim(F.regexp_replace(plain, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")).cast("binary"), 256)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _in(c: Column, names: list[str]) -> Column:
    return c.isin(*names)


def asm_tokens(code: Column, normalize: bool = True) -> Column:
    """Upper-case tokens; normalised, registers, numbers, label definitions and size words are placeholders. Comments and punctuation drop out."""
    raw = F.filter(F.regexp_extract_all(code, F.lit(f"({ASM})"), F.lit(1)), lambda t: ~t.rlike(r"^[;%]"))

    def one(t: Column) -> Column:
        if not normalize:
            return F.upper(F.regexp_replace(t, ":$", ""))
        low = F.lower(t)
        return F.when(_in(low, REGISTERS), "REG").when(t.rlike(NUMBER), "IMM").when(t.endswith(":"), "LABEL").when(_in(low, SIZES), "MEM_SIZE").otherwise(F.upper(t))

    return F.transform(raw, one)


def tokens(text: Column, tokenizer: str, normalize: bool = True) -> Column:
    return asm_tokens(text, normalize) if tokenizer == "asm" else word_tokens(text)


def shingles(ts: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by spaces; all tokens as one where there are fewer; none where there are none."""

    def cut(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(runs)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return let(ts, cut)


def shingle_weight(shingle: Column) -> Column:
    """3 with any rare instruction, 1 if all tokens are common (or there is none), else 2."""
    parts = F.split(shingle, " ")
    rare = F.arrays_overlap(parts, F.array(*map(F.lit, RARE)))
    common = F.forall(parts, lambda t: _in(t, COMMON))
    return F.when(rare, 3).when(common | (shingle == ""), 1).otherwise(2)


def elements(sh: Column, weighted: bool) -> Column:
    """What a signature is taken over: a shingle of weight 1 as it is, one of weight w > 1 as w - 1 ... numbered copies beside its base copy."""
    if not weighted:
        return sh
    copies = lambda s, w: F.when(w == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), w - 1), lambda k: F.concat(s, F.lit("|"), k.cast("string"))))
    return F.flatten(F.transform(sh, lambda s: let(shingle_weight(s), lambda w: copies(s, w))))


def element_hashes(es: Column) -> Column:
    """31-bit hashes: the first eight hex digits of MD5, mod 2**31 - 1."""
    return F.transform(es, lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit((1 << 31) - 1))
