"""License scan: lines of a text compared with licence templates by the Dice coefficient of their word bigrams.

A line and a template are normalised alike: lower-case letters and digits, anything else is white space. Two sets of ``a`` and
``b`` bigrams reach a Dice coefficient of ``t`` only if ``t / (2 - t) <= a / b <= (2 - t) / t``, so a line that is too short for every
template isn't even normalised, and a line is compared only with the templates whose bounds hold its size. All templates of one licence
share its name; a template of several lines is compared with as many lines together.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.llm.common import byte_text, in_small_batches, texts_of

#: SPDX names and short notices by which texts declare these licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Dice coefficient, in hundredths, from which a line counts as a template.
PERCENT = 85
NOT_A_WORD = re.compile(rb"[^0-9a-z]+")


def words_of(line: bytes) -> list[bytes]:
    return NOT_A_WORD.sub(b" ", line.lower()).split()


def bigrams(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:], strict=False))


class Templates:
    """Templates by number of lines and bigrams, so that only sizes within bounds are looked at."""

    def __init__(self, templates: tuple[tuple[str, str], ...], percent: int):
        self.percent = percent
        self.by_size: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for name, text in templates:
            lines = text.encode().split(b"\n")
            grams = bigrams([w for line in lines for w in words_of(line)])
            if not grams:
                raise ValueError(f"template of {name} has less than two words")
            for size in range(-(-percent * len(grams) // (200 - percent)), (200 - percent) * len(grams) // percent + 1):
                self.by_size[len(lines)][size].append((name, grams))
        #: A line of b bigrams has at least b + 1 words and so 2 b + 1 bytes; repeated bigrams only make it longer.
        self.least_bytes = {n: 2 * min(sizes) + 1 for n, sizes in self.by_size.items()}

    def best(self, n_lines: int, grams: frozenset) -> tuple[int, int, str] | None:
        """The template of highest coefficient (ties: first name) that is reached, as hits, sizes and name."""
        found = None
        for name, own in self.by_size[n_lines].get(len(grams), ()):
            both, sizes = len(own & grams), len(own) + len(grams)
            if 200 * both >= self.percent * sizes and (found is None or (-both / sizes, name) < (-found[0] / found[1], found[2])):
                found = (both, sizes, name)
        return found

    def scan(self, text: bytes) -> list[tuple[int, str, float]]:
        """``(first line, name, coefficient)`` of every line, or run of lines, that is a template."""
        lines, out = text.split(b"\n"), []
        for n in self.by_size:
            for i in range(len(lines) - n + 1):
                part = lines[i] if n == 1 else b" ".join(lines[i:i + n])
                if len(part) >= self.least_bytes[n] and (hit := self.best(n, bigrams(words_of(part)))):
                    out.append((i, hit[2], 2 * hit[0] / hit[1]))
        return sorted(out)


def license_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES,
                  percent: int = PERCENT) -> DataFrame:
    """``id, line, license, dice``: one row for every line of every whole text that is a licence template.

    Lines are counted from 0. NULL and empty texts give no rows, nor does an empty table. Rows with equal ids are
    scanned one by one. The templates are a bounded parameter and travel with the function.
    """
    def run(iterator):
        known = Templates(templates, percent)
        for batch in iterator:
            take, line, name, dice = [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                for at, license_name, value in known.scan(text):
                    take.append(i), line.append(at), name.append(license_name), dice.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(line, pa.int64()),
                                              pa.array(name, pa.string()), pa.array(dice, pa.float64())],
                                             [id_col, "line", "license", "dice"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_small_batches(df).select(F.col(id_col), byte_text(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, line long, license string, dice double")
