"""IPv4 addresses packed into longs, as Spark expressions. Addresses order unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUAD = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def pack(text: Column) -> Column:
    """A dotted quad as 0 to 2^32 - 1; anything else is null."""
    part = F.split(text, r"\.")
    value = sum((F.get(part, F.lit(i)).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0))
    return F.when(text.rlike(_QUAD), value)


def unpack(packed: Column) -> Column:
    """The dotted quad of a packed address; null outside 0 to 2^32 - 1."""
    octets = [F.shiftright(packed, 8 * (3 - i)).bitwiseAND(F.lit(255)).cast("string") for i in range(4)]
    return F.when(packed.between(0, (1 << 32) - 1), F.concat_ws(".", *octets))


def subnet_mask(bits: int) -> int:
    if not 0 <= bits <= 32:
        raise ValueError("a prefix has 0 to 32 bits")
    return (1 << 32) - (1 << 32 - bits)


def matches_subnet(packed: Column, network: str, bits: int) -> Column:
    """Whether an address lies in ``network``/``bits``."""
    mask = subnet_mask(bits)
    octets = [int(x) for x in network.split(".")]
    base = sum(o << 8 * (3 - i) for i, o in enumerate(octets)) & mask
    return packed.bitwiseAND(F.lit(mask)) == F.lit(base)
