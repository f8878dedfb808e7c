"""Column functions on text, addresses and trust values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def xml_disarm(text: Column) -> Column:
    """Entities to characters, the ampersand last."""
    for entity, char in (("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?--[ \n\t]*>", "")


def plain_words(text: Column) -> Column:
    """Words of a text without markup."""
    return F.filter(F.split(text, "[,;.: \n\t]+"), lambda w: w != "")


def canonical_word(word: Column) -> Column:
    """Without one closing stop, ASCII letters in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_replace(word, "[.:;,]$", ""), upper, upper.lower())


def canonical_words(text: Column) -> Column:
    """The canonical words of a text without markup; stops part words, so none is left at the end of one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return plain_words(F.translate(text, upper, upper.lower()))


def ip_domain_id(ip: Column, n_bytes: int) -> Column:
    """The first bytes of an address as a negative user id; null for other names."""
    parts = F.slice(F.split(ip, r"\."), 1, n_bytes)
    return F.when(ip.rlike(IPV4), -F.aggregate(parts, F.lit(0).cast("long"), lambda s, b: s * 256 + b.cast("long")))


def revision_bytes(text: Column) -> Column:
    """What a revision takes: the bytes of its text and 200 for the rest."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + 200


def trust_css_class(trust: Column, median: Column) -> Column:
    """Index of the colour class: ten classes over the median, the array index truncated."""
    scaled = (trust + 0.5) * 10 / F.when(median == 0, 1.0).otherwise(median)
    return F.least(F.lit(9.0), F.greatest(F.lit(0.0), scaled)).cast("int")


def trust_bin(trust: Column) -> Column:
    return F.least(F.lit(9), F.greatest(F.lit(0), (trust + 0.5).cast("int")))


def trust_histogram(trust: Column) -> Column:
    """How many words of an array of trust values fall in each of ten bins."""
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.size(F.filter(trust, lambda t: trust_bin(t) == i)))


def overall_trust(histogram: Column) -> Column:
    """(sum of i * h_i) * exp(-0.05 * sum of h_i / 2^i) of a ten-bin histogram."""
    weighted = F.aggregate(F.transform(histogram, lambda h, i: h * i), F.lit(0.0), lambda s, x: s + x)
    damped = F.aggregate(F.transform(histogram, lambda h, i: h / F.pow(F.lit(2.0), i)), F.lit(0.0), lambda s, x: s + x)
    return weighted * F.exp(-0.05 * damped)


def text_decay(life: Column, n: Column, text: Column, steps: int = 5) -> Column:
    """Newton steps from 0 on ``(1 - a) l = a t (1 - a^n)``; no text decays as 1, no life as 0."""

    def step(a: Column, _: Column) -> Column:
        value = (1 - a) * life - a * text * (1 - F.pow(a, n))
        slope = -life - text + text * (n + 1) * F.pow(a, n)
        return a - F.try_divide(value, slope)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.when(text == 0, 1.0).when(life == 0, 0.0).otherwise(solved)


def pack_signature(a: Column, b: Column, c: Column) -> Column:
    """Three ten-bit author hashes in one number."""
    return a.bitwiseOR(F.shiftleft(b, 10)).bitwiseOR(F.shiftleft(c, 20))


def unpack_signature(sig: Column, i: int) -> Column:
    return F.shiftrightunsigned(sig, 10 * i).bitwiseAND(F.lit(1023).cast("long"))


def author_hash(author: Column, word: Column) -> Column:
    """An author's number in the signature of a word: 1 to 1023; 0 stands for nobody."""
    return F.crc32(F.concat_ws(" ", author, word)) % 1023 + 1


def in_signature(sig: Column, author: Column, word: Column) -> Column:
    """Whether an author stands in a word's signature; anonymous authors (0) count as present."""
    h = author_hash(author, word)
    held = unpack_signature(sig, 0) == h
    for i in (1, 2):
        held = held | (unpack_signature(sig, i) == h)
    return (author == 0) | held


def add_to_signature(sig: Column, author: Column, word: Column) -> Column:
    """The signature with the author in front, if not there yet; the oldest of three leaves."""
    return F.when(in_signature(sig, author, word), sig).otherwise(pack_signature(author_hash(author, word), unpack_signature(sig, 0), unpack_signature(sig, 1)))


def stripped_end(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t\n]+$", "")


def normal_space(text: Column) -> Column:
    """Every run of the sequence space, newline, tab becomes one space; one space at each end goes."""
    return F.regexp_replace(F.regexp_replace(text, "(?: \n\t)+", " "), "^ | (?![\\s\\S])", "")


def subfield(info: Column, name: str) -> Column:
    """The value of a field ``name value)`` in a parenthesized list, up to the next closing parenthesis."""
    return F.regexp_extract(info, rf"(?s){name}.([^)]*)\)", 1)


def compact_time(api_time: Column) -> Column:
    """``2008-10-30T12:34:56Z`` as ``20081030123456``."""
    return F.regexp_replace(api_time, r"^(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)Z$", "$1$2$3$4$5$6")


def epoch_of(compact: Column) -> Column:
    """Seconds of a compact time; years before 1970 and what is no time are 0."""
    return F.greatest(F.coalesce(F.unix_timestamp(F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss"))), F.lit(0)), F.lit(0))


def without_broken_escapes(json: Column) -> Column:
    r"""JSON text whose ``\u`` surrogates that have no partner are U+FFFD escapes."""
    pair, alone = r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})", r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
    # pairs are kept by the first group, the rest goes
    parted = F.regexp_replace(json, f"{pair}|{alone}", "$1\\\\uFFFD")
    return F.regexp_replace(parted, f"{pair}\\\\uFFFD", "$1")


def xml_escape(text: Column) -> Column:
    """Characters to entities, the ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def is_robot(listed: Column, name: Column) -> Column:
    """Listed as a robot, or named so."""
    return F.coalesce(listed, F.lit(False)) | F.coalesce(F.lower(name).endswith("bot"), F.lit(False))


def read_share(base: Column, seconds: Column, scale: float, robot: Column, on_line: bool = True) -> Column:
    """How much of its page an author is taken to have read, who came ``seconds`` after the last one; robots read nothing."""
    f = 1 - F.exp(-seconds / scale)
    read = 1 - F.pow(1 - base, f) if on_line else base * f
    return F.when(robot, 0.0).otherwise(read)
