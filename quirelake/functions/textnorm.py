"""Clean-up of recognised text: token marks, LaTeX styles, prompts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of a pattern's \\s, spelt out, as engines differ in the vertical tab.
_S = r"[ \t\n\x0B\f\r]"


def strip(x: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def unbracket(x: Column) -> Column:
    r"""Without \[ and \] where a text has both around it."""
    framed = x.startswith("\\[") & x.endswith("\\]") & (F.length(x) >= 4)
    return F.when(framed, F.substr(x, F.lit(3), F.length(x) - 4)).otherwise(x)


#: Marks of decoded text and what stands for them, in this order.
TOKEN_MARKS = (("Ġ", " "), ("Ċ", "\n"), ("-<|sn|>", ""), (" <|sn|>", " "), ("<|sn|>", " "), ("<|unk|>", ""), ("<s>", ""), ("</s>", ""), ("\uffff", ""))


def clean_tokens(x: Column) -> Column:
    """Byte-level marks to white space, special tokens out (a spacing token after
    a hyphen or a space joins with it), long runs of underscores and dots cut to
    three, display brackets taken off."""
    for mark, text in TOKEN_MARKS:
        x = F.replace(x, F.lit(mark), F.lit(text))
    return unbracket(F.regexp_replace(F.regexp_replace(x, r"_{4,}", "___"), r"\.{4,}", "..."))


#: Commands whose argument stays when their style goes, in this order.
STYLES = ("bm", "boldsymbol", "textit", "textbf", "mathbf")


def remove_style(x: Column) -> Column:
    """Arguments of style commands without the command, up to the first closing
    brace of a line; trimmed, and display brackets taken off."""
    for style in STYLES:
        x = F.regexp_replace(x, rf"\\{style}{_S}*\{{([^\n]*?)\}}", "$1")
    return unbracket(strip(x))


def add_newlines(x: Column) -> Column:
    r"""Line breaks around \begin{...} and \end{...} in place of the blanks there,
    and after \\ (instead of a space, and unless there is one); runs of breaks
    made one. Null is empty."""
    x = F.coalesce(x, F.lit(""))
    for word in ("begin", "end"):
        x = F.regexp_replace(x, rf"{_S}*(\\{word}\{{[^}}]*\}}){_S}*", "\n$1\n")
    x = F.regexp_replace(x, r"\\\\[ \n]?", "\\\\\\\\\n")
    return strip(F.regexp_replace(x, r"\n{2,}", "\n"))


def remove_dollar(x: Column) -> Column:
    """Without the outer pair of double dollars."""
    framed = x.startswith("$$") & x.endswith("$$") & (F.length(x) >= 4)
    return F.when(framed, F.substr(x, F.lit(3), F.length(x) - 4)).otherwise(x)


def remove_text_wrapping(x: Column) -> Column:
    r"""\text{...} around CJK characters unwrapped; quotation marks taken out."""
    return F.replace(F.regexp_replace(x, rf"\\text{_S}*\{{{_S}*([^}}]*?[\u4e00-\u9fff]+[^}}]*?){_S}*\}}", "$1"), F.lit('"'), F.lit(""))


def remove_prompt(x: Column, prompt: str, marks: tuple[str, ...] = ("<pad>", "</s>")) -> Column:
    for mark in (prompt, *marks):
        x = F.replace(x, F.lit(mark), F.lit("")) if mark else x
    return strip(x)


def detokenize(tokens: Column, special: tuple[str, ...] = ("<s>", "</s>", "<pad>")) -> Column:
    """Token strings without space marks and outer blanks; special ones go, null ones are empty."""
    plain = F.transform(tokens, lambda t: strip(F.replace(F.coalesce(t, F.lit("")), F.lit("Ġ"), F.lit(" "))))
    return F.filter(plain, lambda t: ~t.isin(*special))


def end_markers(x: Column, marks: tuple[str, ...] = ("<|end_of_query|>", "<|end_of_text|>")) -> Column:
    """Generated text without its end markers, stripped."""
    return remove_prompt(x, "", marks)


def fill_prompt(template: Column, media: Column, prompt: Column, default: str = "Read all text in the image.") -> Column:
    """Media and prompt put in for their markers; a blank prompt is the default."""
    asked = F.when(prompt.isNull() | (strip(prompt) == ""), F.lit(default)).otherwise(prompt)
    for mark, value in (("{{media}}", media), ("{media}", media), ("{{prompt}}", asked), ("{prompt}", asked)):
        template = F.replace(template, F.lit(mark), value)
    return template


def chat_prompt(template: str, message: Column) -> Column:
    """A chat template with the message for its ``%s``."""
    return F.format_string(template, message)


def image_prompt(rows: Column, cols: Column, tokens: int, mark: str = "<image>") -> Column:
    """Prompt of a tiled image: a labelled run of image tokens a tile, then the whole image."""
    run = mark * tokens
    tile = lambda r, c: F.concat(F.lit("<fake_token_around_image><row_"), (r + 1).cast("string"), F.lit("_col_"), (c + 1).cast("string"), F.lit(f">{run}"))
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), cols - 1), lambda c: tile(r, c)), "")
    tiles = F.when((rows > 0) & (cols > 0), F.array_join(F.transform(F.sequence(F.lit(0), rows - 1), line), "\n")).otherwise("")
    return F.concat(tiles, F.when((rows > 0) & (cols > 0), F.lit("\n\n")).otherwise(""), F.lit(f"<fake_token_around_image><global-img>{run}<fake_token_around_image>"))


def without_blanks(x: Column) -> Column:
    """Without every white-space character."""
    return F.regexp_replace(x, r"\s", "")


def shorten(x: Column, most: int = 200) -> Column:
    """At most so many characters, an ellipsis after a cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


# Patterns of the spacing rules.
_OPERATOR = re.compile(r"\\(?:operatorname|mathrm|text|mathbf)[ \t\n\x0b\f\r]?\*? \{[^\n\r]*?\}")
_COMMAND = re.compile(r"(\\[a-zA-Z]+)\s(?=\w)|\\[a-zA-Z]+\s(?=\})", re.ASCII)
_OPERATORS = (r"\operatorname", r"\mathrm", r"\text", r"\mathbf")
#: Stands for a space that must stay.
_HELD = "\ue000"
#: The mark counts as a letter in every rule, as the letters that stand for it do.
_LETTER = f"a-zA-Z{_HELD}"
_NEEDLESS = tuple(re.compile(p, re.ASCII) for p in (rf"(?!\\ )([^{_LETTER}])\s+?([^{_LETTER}])", rf"(?!\\ )([^{_LETTER}])\s+?([{_LETTER}])", rf"([{_LETTER}])\s+?([^{_LETTER}])"))


def normalize_latex_text(text: str) -> str:
    """Spaces that LaTeX doesn't need taken out, until nothing changes.

    Where a command stands within the braces of an operator name, all spaces of
    the text go at once, but those after that command.
    """
    for found in _OPERATOR.finditer(text):
        for inner in _COMMAND.finditer(found[0]):
            name = inner[1] or inner[0]
            if name not in _OPERATORS:
                text = text.replace(name, name + _HELD).replace(" ", "")
    while True:
        now = text
        for rule in _NEEDLESS:
            now = rule.sub(r"\1\2", now)
        if now == text:
            return text.replace(_HELD, " ")
        text = now


#: Bytes of text that are Python strings at once, unless one text has more.
_AT_ONCE = 1 << 20


def in_slices(work: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """``work`` over texts, a slice of an Arrow batch at a time, so that few of them
    are Python strings at once; null stays."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    done = [pa.array([None if t is None else work(t) for t in texts.slice(a, b - a).to_pylist()], pa.string()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.concat_arrays(done)


@F.arrow_udf(T.StringType())
def normalize_latex(x: pa.Array) -> pa.Array:
    """``normalize_latex_text`` over a column; it runs to a fixed point, which no built-in does."""
    return in_slices(normalize_latex_text, x)
