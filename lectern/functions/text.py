"""String, regex and template functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that ban a title, and the mark that ends a description.
BLACKLIST = ("QA", "TA", "Homework", "助教", "Guest")
END_MARK = "[END]"
# What is cut from descriptions and from model output, and the characters that end a prompt.
DESCRIBE, STOP, END_OF_TEXT = "Describe :", "|end|>", "<|endoftext|>"


def sanitize_title(title: Column) -> Column:
    return F.translate(title, "|/\\.:", "")


def allowed_title(title: Column, banned=BLACKLIST) -> Column:
    """Case-sensitive substring test, on the sanitised title."""
    clean = sanitize_title(title)
    hit = F.lit(False)
    for word in banned:
        hit = hit | clean.contains(word)
    return ~hit


def stem_first(name: Column) -> Column:
    """Up to the first dot."""
    return F.substring_index(name, ".", 1)


def stem_last(name: Column) -> Column:
    """Without the last dot and what follows."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def drop_anywhere(name: Column, suffix: str) -> Column:
    """Every occurrence of a suffix, wherever it stands."""
    return F.replace(name, F.lit(suffix), F.lit(""))


def cut_end(name: Column, n: int) -> Column:
    """Without the last ``n`` characters, whatever they are."""
    return F.substring(name, F.lit(1), F.greatest(F.length(name) - n, F.lit(0)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"_(\d+)\.", 1).try_cast("int")


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip_chars(text: Column, chars: str) -> Column:
    """Any of ``chars`` off the right end, in any order: a set, not a suffix."""
    return F.rtrim(text, F.lit(chars))


def drop_literal(text: Column, literal: str) -> Column:
    return F.replace(text, F.lit(literal), F.lit(""))


def clean_output(text: Column) -> Column:
    """Model output without its stop mark."""
    return drop_literal(text, STOP)


def prompt_end(prompt: Column) -> Column:
    """A prompt without the characters of the end-of-text mark, if it ends with that mark."""
    return F.when(prompt.endswith(END_OF_TEXT), rstrip_chars(prompt, END_OF_TEXT)).otherwise(prompt)


def occurrences(text: Column, literal: str) -> Column:
    """How often a non-empty literal stands in the text."""
    return (F.length(text) - F.length(drop_literal(text, literal))) / len(literal)


def descriptions(raw: Column) -> Column:
    """``Image k: body [END]`` text as an array of (k, body), the last body of a repeated k, ascending.

    Bodies lose end marks, outer white space and outer runs of asterisks; text before the first marker is ignored.
    """
    joined = drop_literal(F.regexp_replace(raw, r"\n+(Image \d+:)", "$1"), END_MARK)
    pattern = F.lit(r"(?s)Image (\d+):\s*(.*?)(?=Image \d+:|\z)")
    keys = F.transform(F.regexp_extract_all(joined, pattern, F.lit(1)), lambda k: k.cast("int"))
    bodies = F.transform(F.regexp_extract_all(joined, pattern, F.lit(2)), lambda b: strip(F.regexp_replace(strip(b), r"^\*+|\*+$", "")))
    last = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(F.arrays_zip(keys.alias("k"), bodies.alias("b")), lambda p: p["k"] == k), -1)["b"].alias("body")))
    return F.array_sort(last)


def complete(found: Column, expected: Column) -> Column:
    """All descriptions there and none empty."""
    return (F.size(found) == expected) & ~F.exists(found, lambda d: d["body"] == "")


def valid_model_output(raw: Column, boxes: Column) -> Column:
    """As many ``Image`` chunks as boxes, and none empty."""
    return (F.size(F.split(raw, "Image ")) - 1 == boxes) & ~F.exists(F.split(raw, "Image "), lambda c: c.contains(": [END]"))


# What stands around the label in an answer.
ANSWER_HEAD, ANSWER_TAIL = '最可能對應的是:"', '"'


def answer(label: Column) -> Column:
    return F.concat(F.lit(ANSWER_HEAD), label.cast("string"), F.lit(ANSWER_TAIL))


def parse_answer(text: Column) -> Column:
    """The label in an answer; -1 if there is no number."""
    return F.coalesce(strip(drop_literal(drop_literal(text, ANSWER_HEAD), ANSWER_TAIL)).try_cast("int"), F.lit(-1))


def subtitle(previous: Column, current: Column, following: Column) -> Column:
    """``[-k]text … [0]text … [k]text`` of arrays of texts around the current one."""
    before = F.transform(previous, lambda t, i: F.concat(F.lit("[-"), (F.size(previous) - i).cast("string"), F.lit("]"), t))
    after = F.transform(following, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), t))
    return F.array_join(F.concat(before, F.array(F.concat(F.lit("[0]"), current)), after), "")


def candidates(options: Column) -> Column:
    """A numbered line for each option."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("\n"), i.cast("string"), F.lit(':"'), o, F.lit('"'))), "")


# A region's tag, and what ends a training answer.
def image_tags(count: Column, first: int = 2) -> Column:
    """A tag for each region; the page itself is image 1."""
    tags = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit("<|image_"), (i + first - 1).cast("string"), F.lit("|>")))
    return F.when(count > 0, F.array_join(tags, "")).otherwise("")


def model_answer(texts: Column) -> Column:
    """The training answer that describes all regions."""
    each = F.transform(texts, lambda t, i: F.concat(F.lit("Image "), i.cast("string"), F.lit(":"), t, F.lit("[END]\n")))
    return F.concat(F.array_join(each, ""), F.lit("|end|><|endoftext|>"))


def same_label(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))
