"""Ligand and protein strings as column expressions: lexing, tokens, windows, pooling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources.elements import SYMBOLS

_PAIRS = "|".join(sorted(s for s in SYMBOLS if len(s) == 2))
IN_BRACKETS = rf"({_PAIRS}|[st]e|as|[A-Z]|[bcnops]|\d|[-+@:*])"
IN_CHAIN = r"(Br|Cl|[A-Z]|[bcnops]|\d|[-#%()+\\/.=@:*~<>$\]])"
RESIDUES = "ABCDEFGHIKLMNOPQRSTUVWXYZ"
BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"


def smiles_tokens(smiles: Column) -> Column:
    """The tokens of a SMILES string, bracket atoms taken apart; an error where a character belongs to none."""
    pieces = F.regexp_extract_all(smiles, F.lit(r"(\[[^\]]*\]|[^\[]+)"), 1)
    inner = lambda p: F.regexp_extract_all(F.substring(p, 2, 1 << 30), F.lit(IN_BRACKETS), 1)
    split = lambda p: F.when(p.startswith("["), F.concat(F.array(F.lit("[")), inner(p), F.array(F.lit("]")))).otherwise(F.regexp_extract_all(p, F.lit(IN_CHAIN), 1))
    tokens = F.flatten(F.transform(pieces, split))
    whole = smiles.isNotNull() & (smiles != "") & (F.array_join(tokens, "") == smiles)
    return F.when(whole, tokens).otherwise(F.raise_error(F.concat(F.lit("no SMILES: "), F.coalesce(smiles, F.lit("null")))).cast("array<string>"))


def ligand_tokens(smiles: Column, indices: dict[str, int], most: int = 256, truncate: bool = False, unknown: bool = False) -> Column:
    """struct(ids, tokens_total, tokens_omitted, unknown_encoded): ids between those of begin and end.

    More tokens than fit, and tokens without an index, are errors unless they are allowed.
    """
    if most < 3:
        raise ValueError("at least three positions are needed")
    tokens = smiles_tokens(smiles)
    index = F.create_map(*[F.lit(x) for kv in indices.items() for x in kv])
    n, kept = F.size(tokens), F.slice(tokens, 1, most - 2)
    if not truncate:
        kept = F.when(n <= most - 2, kept).otherwise(F.raise_error(F.lit("a ligand has too many tokens")).cast("array<string>"))
    missing = F.filter(kept, lambda t: F.try_element_at(index, t).isNull())
    rest = F.lit(indices.get(UNKNOWN)).cast("int") if unknown else F.raise_error(F.lit("a token has no index")).cast("int")
    ids = F.concat(F.array(F.lit(indices[BEGIN])), F.transform(kept, lambda t: F.coalesce(F.try_element_at(index, t), rest)), F.array(F.lit(indices[END])))
    return F.struct(ids.alias("ids"), n.alias("tokens_total"), F.greatest(F.lit(0), n - (most - 2)).alias("tokens_omitted"), F.size(missing).alias("unknown_encoded"))


def protein_windows(sequence: Column, width: int = 1022) -> Column:
    """The whole sequence in windows that don't overlap; an error for other letters than those of residues."""
    if not 1 <= width <= 1022:
        raise ValueError("a window has 1 to 1022 residues")
    starts = F.sequence(F.lit(0), F.floor((F.length(sequence) - 1) / width).cast("int"))
    windows = F.transform(starts, lambda k: F.substr(sequence, k * width + 1, F.lit(width)))
    return F.when(F.coalesce(sequence.rlike(f"^[{RESIDUES}]+$"), F.lit(False)), windows).otherwise(F.raise_error(F.lit("no protein sequence")).cast("array<string>"))


def weighted_mean(vector: Column, weight: Column, length: int) -> Column:
    """An aggregate: the mean of vectors of one length, by weights that are positive."""
    return F.array(*[F.sum(F.get(vector, F.lit(k)) * weight) / F.sum(weight) for k in range(length)])
