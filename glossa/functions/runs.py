"""Run-name and grid expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run names look like exp32_k1024_lr3e-04_aux1e+00_tgt2e-02
# or exp32_k1024_lr3e-04_noaux.
RUN_PATTERNS = {
    "expansion": r"exp(\d+)",
    "k": r"_k(\d+)",
    "lr": r"_lr([0-9.]+e[-+]\d+)",
    "aux": r"_aux([0-9.]+e[-+]\d+)",
    "target": r"_tgt([0-9.]+e[-+]\d+)",
}
MIN_SPARSITY = 1024          # sparsity grid step and floor


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def run_name(expansion, k, lr, aux, target) -> Column:
    """Writer of run names: ``exp{e}_k{k}_lr{lr:.0e}_aux{aux:.0e}_tgt{t:.0e}``,
    or ``..._noaux`` when the aux coefficient is 0.  ``lr``, ``aux`` and
    ``target`` are given as their formatted strings (see ``sci``)."""
    base = F.concat(F.lit("exp"), _c(expansion).cast("string"), F.lit("_k"),
                    _c(k).cast("string"), F.lit("_lr"), _c(lr))
    return F.when(_c(aux) == sci(F.lit(0.0)), F.concat(base, F.lit("_noaux"))).otherwise(
        F.concat(base, F.lit("_aux"), _c(aux), F.lit("_tgt"), _c(target)))


def sci(x) -> Column:
    """Python's ``format(x, '.0e')`` for positive doubles and 0:
    one mantissa digit, signed two-digit exponent (``3e-04``, ``1e+00``)."""
    v = _c(x).cast("double")
    e = F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(v))).cast("int"))
    mant = F.round(v / F.pow(F.lit(10.0), e), 0).cast("int")
    # rounding can carry into the next power of ten (9.6e-4 -> 1e-03)
    e2 = F.when(mant >= 10, e + 1).otherwise(e)
    mant2 = F.when(mant >= 10, F.lit(1)).otherwise(mant)
    sign = F.when(e2 < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(mant2.cast("string"), F.lit("e"), sign,
                    F.lpad(F.abs(e2).cast("string"), 2, "0"))


def parse_run(name) -> dict[str, Column]:
    """Expansion and k as integers; lr, aux, target as doubles (null
    when absent, e.g. ``_noaux``)."""
    n = _c(name)
    out = {}
    for key, pat in RUN_PATTERNS.items():
        raw = F.regexp_extract(n, pat, 1)
        val = F.when(raw == "", F.lit(None)).otherwise(raw)
        out[key] = val.cast("long") if key in ("expansion", "k") else val.cast("double")
    return out


def analysis_key(parent, checkpoint, threshold) -> Column:
    """``<parent>_final`` / ``<parent>_step_<n>`` / ``<parent>_<name>``
    for checkpoints ``final``, ``step_<n>`` or another name, plus
    ``_mask<threshold with '.' -> '_'>``."""
    ck = _c(checkpoint)
    tail = F.when(ck == "final", F.lit("final")).otherwise(ck)
    th = F.regexp_replace(_c(threshold).cast("string"), r"\.", "_")
    return F.concat(_c(parent), F.lit("_"), tail, F.lit("_mask"), th)


def sparsity_for(dict_size, ratio) -> Column:
    """``max(1024, ceil(int(dict * ratio) / 1024) * 1024)``, capped at
    the dictionary size."""
    raw = F.floor(_c(dict_size) * _c(ratio)).cast("long")
    step = F.ceil(raw / F.lit(MIN_SPARSITY)).cast("long") * MIN_SPARSITY
    return F.least(F.greatest(F.lit(MIN_SPARSITY), step), _c(dict_size).cast("long"))
