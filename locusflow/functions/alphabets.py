"""Alphabets as letter orders, and letter functions as Spark expressions.

An alphabet is known by its letters in index order; letters count in either case and keep theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    name: str
    letters: str
    gap: str
    ambiguous: str
    moltype: str
    pairs: tuple[str, str] | None = None

    def both(self) -> str:
        """All letters, in both cases."""
        return "".join(dict.fromkeys(self.letters + self.letters.upper()))

    def pattern(self) -> str:
        """A regex class of the letters."""
        return "[" + "".join("\\" + c if c in "-*" else c for c in self.both()) + "]"

    def invalid(self) -> str:
        return "[^" + self.pattern()[1:]


# Letters in index order, gap and ambiguous letters, complement pairs.
DNA_PAIRS = ("acgtmrwsykvhdbn-", "tgcakywsrmbdhvn-")
RNA_PAIRS = ("acgumrwsykvhdbn-", "ugcakywsrmbdhvn-")
ALPHABETS = {
    a.name: a
    for a in (
        Alphabet("DNA", "acgt", "-", "n", "DNA", DNA_PAIRS),
        Alphabet("DNAgapped", "-acgt", "-", "n", "DNA", DNA_PAIRS),
        Alphabet("DNAredundant", "-acmgrsvtwyhkdbn", "-", "n", "DNA", DNA_PAIRS),
        Alphabet("RNA", "acgu", "-", "n", "RNA", RNA_PAIRS),
        Alphabet("RNAgapped", "-acgu", "-", "n", "RNA", RNA_PAIRS),
        Alphabet("RNAredundant", "-acmgrsvuwyhkdbn", "-", "n", "RNA", RNA_PAIRS),
        Alphabet("Protein", "-abcdefghijklmnpqrstvwxyz*", "-", "x", "Protein"),
    )
}


def _of(alphabet: str | Alphabet) -> Alphabet:
    return alphabet if isinstance(alphabet, Alphabet) else ALPHABETS[alphabet]


def first_invalid(seq: Column, alphabet: str = "DNA") -> Column:
    """Place of the first letter outside the alphabet, or -1."""
    return F.regexp_instr(seq, F.lit("(?s)" + _of(alphabet).invalid())) - 1


def is_valid(seq: Column, alphabet: str = "DNA") -> Column:
    return first_invalid(seq, alphabet) < 0


def letter_index(letter: Column, alphabet: str = "DNA") -> Column:
    """Index of a letter, or -1."""
    return F.instr(F.lit(_of(alphabet).letters), F.lower(letter)) - F.when(letter == "", 2).otherwise(1)


def index_letter(index: Column, alphabet: str = "DNA") -> Column:
    letters = _of(alphabet).letters
    return F.when(index.between(0, len(letters) - 1), F.substring(F.lit(letters), index + 1, F.lit(1)))


def complement(seq: Column, alphabet: str = "DNA") -> Column:
    """Letters become their partners in the same case; others stay."""
    pairs = _of(alphabet).pairs
    if pairs is None:
        raise ValueError("the alphabet has no complement")
    return F.translate(seq, pairs[0] + pairs[0].upper(), pairs[1] + pairs[1].upper())


def revcomp(seq: Column, alphabet: str = "DNA") -> Column:
    return F.reverse(complement(seq, alphabet))


def moltype_code(name: Column) -> Column:
    """Undefined 0, DNA 1, RNA 2, Protein 3 of a name in any case; null if it is none."""
    low = F.lower(name)
    return F.when(low == "undefined", 0).when(low == "dna", 1).when(low == "rna", 2).when(low == "protein", 3)


def strand_text(strand: Column) -> Column:
    return F.when(strand == 1, "+").when(strand == -1, "-").when(strand == 0, ".")


def strand_code(text: Column) -> Column:
    return F.when(text == "+", 1).when(text == "-", -1).when(text == ".", 0).cast("tinyint")


def one_to_zero(p: Column) -> Column:
    """One-based to zero-based; 0 is no one-based position."""
    return F.when(p == 0, F.raise_error(F.lit("position 0 in one-based coordinates"))).when(p > 0, p - 1).otherwise(p)


def zero_to_one(p: Column) -> Column:
    return F.when(p >= 0, p + 1).otherwise(p)
