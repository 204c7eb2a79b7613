"""Token-id array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
PAD_ID = 0
UNK_ID = 1
BOS_ID = 2
EOS_ID = 3
MAX_LEN = 64


def _ints(c: Column) -> Column:
    return c.cast("array<int>")


def _padding(size: Column, length: int, pad: int) -> Column:
    return F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - size, F.lit(0)))


def add_bos_eos(ids: Column, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    return F.concat(F.array(F.lit(bos)), _ints(ids), F.array(F.lit(eos)))


def pad_or_trim(ids: Column, length: int = MAX_LEN, pad: int = PAD_ID, eos: int = EOS_ID) -> Column:
    """Training form: short sequences are padded; at ``length`` or more the
    first ``length - 1`` ids are kept and the end marker is written last."""
    ids = _ints(ids)
    return F.when(F.size(ids) < length, F.concat(ids, _padding(F.size(ids), length, pad))).otherwise(
        F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(eos)))
    )


def pad_or_slice(ids: Column, length: int = MAX_LEN, pad: int = PAD_ID) -> Column:
    """Inference form: cut at ``length`` without an end marker, then pad."""
    ids = F.slice(_ints(ids), 1, length)
    return F.concat(ids, _padding(F.size(ids), length, pad))


def drop_special(ids: Column, special: tuple[int, ...] = (PAD_ID, BOS_ID, EOS_ID)) -> Column:
    """Removes marker ids; order and duplicates stay."""
    return F.filter(_ints(ids), lambda x: ~x.isin(*special))


def decoder_input(ids: Column) -> Column:
    """All but the last id."""
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def decoder_label(ids: Column) -> Column:
    """All but the first id."""
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def padding_mask(ids: Column, pad: int = PAD_ID) -> Column:
    return F.transform(ids, lambda x: x == pad)
