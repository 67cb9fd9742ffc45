"""Array / token-id functions (H20-H30) as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "truncate_ids", "pad_ids", "decoder_input", "decoder_target", "pad_mask",
    "loss_mask", "pad_to_power_of_two", "collate_pad", "labels_to_ids",
    "prompt_of", "target_of", "strip_special_tokens", "ids_text", "guard_empty_ids",
    "shift_inputs", "shift_targets", "ngrams",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate_ids(a, n: int) -> Column:
    """Keep the first n ids (``ids[:n]``)."""
    if n <= 0:
        return F.slice(_c(a), 1, 0)
    return F.slice(_c(a), 1, n)


def pad_ids(a, n: int, pad: int = 0) -> Column:
    """Right-pad to n with ``pad`` then cut to n."""
    return F.slice(F.concat(_c(a), F.array_repeat(F.lit(pad), n)), 1, n)


def decoder_input(ids, sos: int = 1) -> Column:
    """``[SOS] + ids``."""
    return F.concat(F.array(F.lit(sos)), _c(ids))


def decoder_target(ids, eos: int = 2) -> Column:
    """``ids + [EOS]``."""
    return F.concat(_c(ids), F.array(F.lit(eos)))


def pad_mask(a, pad: int = 0) -> Column:
    """Boolean mask, true where the element is padding."""
    return F.transform(_c(a), lambda x: x == F.lit(pad))


def loss_mask(n_prefix, n_target, total=None) -> Column:
    """Zeros over the prefix, ones over the target, zeros to ``total``."""
    ones = F.concat(F.array_repeat(F.lit(0), _c(n_prefix)), F.array_repeat(F.lit(1), _c(n_target)))
    if total is None:
        return ones
    tot = F.lit(total) if isinstance(total, int) else _c(total)
    return F.concat(ones, F.array_repeat(F.lit(0), F.greatest(tot - F.size(ones), F.lit(0))))


def pad_to_power_of_two(a, pad: int = 0) -> Column:
    """Pad to 2^ceil(log2(len+1))."""
    n = F.size(_c(a))
    target = F.pow(F.lit(2.0), F.ceil(F.log2(n + 1))).cast("int")
    return F.concat(_c(a), F.array_repeat(F.lit(pad), target - n))


def collate_pad(a, longest, pad: int = 0) -> Column:
    """Pad to the batch's longest sequence (``longest`` is a column)."""
    return F.concat(_c(a), F.array_repeat(F.lit(pad), _c(longest) - F.size(_c(a))))


def labels_to_ids(a, pad: int = 0, ignore: int = -100) -> Column:
    """Replace the ignore label by the pad id."""
    return F.transform(_c(a), lambda x: F.when(x == F.lit(ignore), F.lit(pad)).otherwise(x))


def prompt_of(a, sep: int = 4, fallback: int = 10) -> Column:
    """Ids up to and including the first SEP; no SEP -> first ``fallback`` ids."""
    pos = F.array_position(_c(a), F.lit(sep)).cast("int")
    return F.when(pos > 0, F.slice(_c(a), F.lit(1), pos)).otherwise(F.slice(_c(a), 1, fallback))


def target_of(a, sep: int = 4) -> Column:
    """Ids after the first SEP (empty if there is none)."""
    pos = F.array_position(_c(a), F.lit(sep)).cast("int")
    n = F.size(_c(a))
    return F.when(pos > 0, F.slice(_c(a), pos + 1, F.greatest(n - pos, F.lit(0)))) \
        .otherwise(F.slice(_c(a), 1, 0))


def strip_special_tokens(a, mode: str = "all", specials=(0, 1, 2, 3), sos: int = 1, eos: int = 2) -> Column:
    """``all`` drops every special id; ``first`` removes only the first
    SOS and the first EOS; ``ends`` drops the first and last element."""
    a = _c(a)
    if mode == "all":
        sp = F.array(*[F.lit(s) for s in specials])
        return F.filter(a, lambda x: ~F.array_contains(sp, x))
    if mode == "ends":
        return F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))
    if mode == "first":
        def drop_first(arr, v):
            p = F.array_position(arr, F.lit(v)).cast("int")
            return F.when(p > 0, F.concat(F.slice(arr, 1, p - 1),
                                          F.slice(arr, p + 1, F.greatest(F.size(arr) - p, F.lit(0))))
                          ).otherwise(arr)
        return drop_first(drop_first(a, sos), eos)
    raise ValueError(f"unknown mode {mode!r}")


def ids_text(a, sep: str = " ") -> Column:
    """Arrays rendered as text (stable form for hashing and CSV)."""
    return F.array_join(F.transform(_c(a), lambda x: x.cast("string")), sep)


def guard_empty_ids(a, placeholder: int = 3) -> Column:
    """An empty id list becomes one placeholder id."""
    return F.when(F.size(_c(a)) == 0, F.array(F.lit(placeholder))).otherwise(_c(a))


def shift_inputs(a) -> Column:
    """Inputs ``seq[:-1]``."""
    return F.slice(_c(a), 1, F.greatest(F.size(_c(a)) - 1, F.lit(0)))


def shift_targets(a) -> Column:
    """Targets ``seq[1:]``."""
    return F.slice(_c(a), 2, F.greatest(F.size(_c(a)) - 1, F.lit(0)))


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams of a token array, each joined by one space."""
    t = _c(tokens)
    if n == 1:
        return t
    k = F.size(t) - n + 1
    # the array is zipped with itself, moved by one: it is read n times in all, and not once per position
    size = F.greatest(k, F.lit(0))
    grams = F.slice(t, 1, size)
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(t, j + 1, size), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(k > 0, grams).otherwise(F.array().cast("array<string>"))
