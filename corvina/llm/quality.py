"""Line-first cleaning.

Every line with a word is judged on its own: punctuation (it must end a sentence, not shout and not be full of
symbols), navigation (menus joined by separators) and boilerplate (licence and site phrases). Lines that fail are
removed; a document that so loses more than half of its words is rejected. Before that a document is rejected on its
base figures: too few words, or too many words inside eight-word windows that occur again in the same text.

Words are runs of characters other than ASCII white space. Repeated windows are found exactly: words become numbers,
and three rounds of pairing neighbours turn them into numbers of windows of two, four and eight words.

Cases: null and empty text has no words and is rejected. Lines without a word are kept and count nothing. Equal rows
get equal verdicts. An empty table gives no rows. Columns other than the id and the text are ignored, or stay as they
are where rows are cleaned. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvina.llm.common import chunks

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A document must keep at least this share of its words, in percent.
MIN_KEPT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Fixed values of the line rules; the same patterns stand in the SQL form.
ENDING = r"[.!?:;…\"'”’»)\]][\x20\x09-\x0D]*$"
PHRASES = [
    # English
    "licensed under", "released under the", "all rights reserved", "copyright", "terms of (?:use|service)", "privacy policy", "cookies", "javascript", "click here", "sign up", "subscribe", "lorem ipsum",
    # French
    "sous licence", "tous droits réservés", "mentions légales", "conditions d.utilisation", "politique de confidentialité", "cliquez ici", "inscrivez-vous", "abonnez-vous",
    # German
    "lizenziert unter", "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "hier klicken", "klicken sie hier", "abonnieren sie",
    # Spanish
    "bajo (?:la )?licencia", "todos los derechos reservados", "términos (?:de uso|y condiciones)", "política de privacidad", "aviso legal", "haga clic", "regístrese", "suscríbase",
]
BOILERPLATE = "(?i)" + "|".join(PHRASES)
#: Fixed value: characters that part the entries of a menu. A closing guillemet is one where none is opened.
SEPARATORS = "|›·•→"

_ENDING, _BOILERPLATE = re.compile(ENDING), re.compile(BOILERPLATE)
_ODD = re.compile("[!»#*$%&<>" + SEPARATORS + "]")
#: The part of each phrase before any choice: a text that holds none of them holds no phrase.
_KEYS = [re.split(r"[.(]", p)[0] for p in PHRASES]


def line_fails(line: str, words: int, phrases: bool = True) -> bool:
    """Whether a line of so many words is to be removed; `phrases`: whether its text may hold any."""
    if not _ENDING.search(line):
        return True
    if _ODD.search(line):
        if (bangs := line.count("!")) >= 3 and bangs > words:
            return True
        parts = sum(map(line.count, SEPARATORS)) + (0 if "«" in line else line.count("»"))
        if parts >= 2 and 4 * parts > words:
            return True
        symbols = sum(map(line.count, "#*$%&<>"))
        if symbols >= 3 and 5 * symbols > words:
            return True
    return phrases and _BOILERPLATE.search(line) is not None


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, how many of its words stand in an eight-word window found twice or more in that text."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    if len(doc) < WINDOW:
        return np.zeros(len(words), dtype=np.int64)
    vocab: defaultdict = defaultdict()
    vocab.default_factory = vocab.__len__
    code = np.fromiter((vocab[x] for w in words for x in w), dtype=np.int64, count=len(doc))
    step = 1
    while step < WINDOW:
        code = np.unique(code[:-step] * (int(code.max()) + 1) + code[step:], return_inverse=True)[1].astype(np.int64)
        step *= 2
    start, inside = doc[: len(code)], doc[: len(code)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    key = start[at] * (int(code.max()) + 1) + code[at]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    edge = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words))


def judge(texts: list[str | None]) -> dict[str, list]:
    """All figures, the verdict and the cleaned text of each text."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    repeats = repeat_words(words).tolist()
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "kept_words", "clean_text")}
    for text, own, repeat in zip(texts, words, repeats):
        n = len(own)
        seen: set[str] = set()
        duplicates = bad = kept_words = 0
        keep = []
        low = text.lower()
        phrases = any(k in low for k in _KEYS)
        for line in text.split("\n"):
            count = len(line.encode().split())
            if not count:
                keep.append(line)
                continue
            if line in seen:
                duplicates += 1
            seen.add(line)
            if line_fails(line, count, phrases):
                bad += 1
            else:
                keep.append(line)
                kept_words += count
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        for k, v in (
            ("n_words", n), ("word_chars", len(text) - sum(map(text.count, SPACE))), ("n_symbols", sum(map(text.count, SYMBOLS))), ("n_dup_lines", duplicates), ("n_repeat_words", repeat),
            ("base_failed", failed), ("kept", not failed and 100 * kept_words >= MIN_KEPT_PERCENT * n), ("n_bad_lines", bad), ("kept_words", kept_words), ("clean_text", "\n".join(keep) if bad else text),
        ):
            out[k].append(v)
    return out


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, figures, verdict, clean_text) of every whole text."""
    slim = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            out = judge(b.column(1).to_pylist())
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds))], ["id", *out])

    return slim.mapInArrow(run, f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, kept_words long, clean_text string")


def cleaned_documents(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows that stay, with cleaned text and every other column as it was; a character count follows the text."""
    names = df.columns
    at = names.index(text_col)
    again = names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, f"c{at}"):
            out = judge(b.column(at).to_pylist())
            keep = pa.array(out["kept"], pa.bool_())
            columns = list(b.columns)
            columns[at] = pa.array(out["clean_text"], pa.string())
            if again is not None:
                columns[again] = pa.array([len(t) for t in out["clean_text"]]).cast(columns[again].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema.set(at, pa.field(f"c{at}", pa.string()))).filter(keep)

    # Columns go by place, so their names may be any.
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)
