"""Integer codes of the chunk format as column expressions: varints, checksum masks, size rules. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BLOCK = 8 << 20
MIN_CODED = 16
MASK_ADD = 0xA282EAD8  # fixed value of the stream format


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def max_encoded_len(n) -> Column:
    """Upper bound of a block's size: 1 for nothing, n + 2 up to 8 MiB, null beyond."""
    n = col(n).cast("long")
    return F.when(n == 0, F.lit(1)).when((n > 0) & (n <= MAX_BLOCK), n + 2).cast("long")


def must_store(n) -> Column:
    """Whether a block is too short to be worth coding."""
    return col(n) < MIN_CODED


def uvarint_len(n) -> Column:
    """Bytes of an unsigned LEB128 number (of a non-negative bigint)."""
    n = col(n).cast("long")
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(n), "^0+", "")) / 7)).cast("int")


def uvarint(n) -> Column:
    """An unsigned LEB128 number as BINARY."""
    n = col(n).cast("long")
    size = uvarint_len(n)
    part = lambda i: F.pmod(F.floor(n / F.pow(F.lit(2.0), 7 * i)), F.lit(128)).cast("long")
    digits = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(part(i) + F.when(i < size - 1, F.lit(128)).otherwise(F.lit(0))), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def uvarint_value(b) -> Column:
    """The number at the beginning of BINARY; null if it does not end within it (of up to nine bytes)."""
    digits = F.regexp_extract(F.hex(col(b)), "^((?:[89A-F].){0,8}[0-7].)", 1)
    part = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long").bitwiseAND(F.lit(127))
    value = sum((F.shiftleft(F.coalesce(part(i), F.lit(0)).cast("long"), 7 * i) for i in range(9)), F.lit(0).cast("long"))
    return F.when(F.length(digits) > 0, value)


def le_value(b, width: int) -> Column:
    """The number whose low byte comes first, from BINARY of at least so many bytes."""
    digits = F.hex(col(b))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("long")


def zigzag(n) -> Column:
    n = col(n).cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z) -> Column:
    z = col(z).cast("long")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def mask_crc(crc) -> Column:
    """The rotated and shifted form in which a checksum is stored."""
    c = col(crc).cast("long")
    turned = F.shiftrightunsigned(c, 15).bitwiseOR(F.shiftleft(c, 17))
    return (turned + F.lit(MASK_ADD)).bitwiseAND(F.lit(0xFFFFFFFF))


def unmask_crc(masked) -> Column:
    m = (col(masked).cast("long") - F.lit(MASK_ADD)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(m, 17).bitwiseOR(F.shiftleft(m, 15)).bitwiseAND(F.lit(0xFFFFFFFF))


def size_indicator(block_size) -> Column:
    """The identifier's nibble for a block size from 4 KiB to 8 MiB: the next power of two over 1 KiB."""
    return (F.length(F.bin(col(block_size).cast("long") - 1)) - 10).cast("int")


def indicated_size(indicator) -> Column:
    size = F.pow(F.lit(2.0), F.pmod(col(indicator).cast("int"), F.lit(16)) + 10).cast("long")
    return F.when(size <= MAX_BLOCK, size)


def offset_symbol(offset) -> Column:
    """The symbol of a match offset: itself below 16, then eight symbols per power of two."""
    o = col(offset).cast("long")
    top = F.length(F.bin(o)) - 1  # the highest bit's place
    scaled = F.floor(o / F.pow(F.lit(2.0), top - 3)).cast("long")
    return F.when(o < 16, o).otherwise((top * 8 - 16) + (scaled - 8)).cast("int")


def offset_extra_bits(symbol) -> Column:
    s = col(symbol).cast("int")
    return F.when(s < 16, F.lit(0)).otherwise(F.floor((s + 16) / 8).cast("int") - 3)


def offset_base(symbol) -> Column:
    s = col(symbol).cast("int")
    return F.when(s < 16, s.cast("long")).otherwise(((8 + F.pmod(s + 16, F.lit(8))) * F.pow(F.lit(2.0), offset_extra_bits(s))).cast("long"))


def literal_code_len(n) -> Column:
    """Bytes that the header of a run of n literals takes."""
    n = col(n)
    return F.when(n <= 0, 0).when(n <= 29, 1).when(n < 30 + 256, 2).when(n < 30 + 65536, 3).otherwise(4)


def copy_code_len(offset, length) -> Column:
    """Bytes of the shortest single copy code for an offset and a length of 4 or more."""
    o, n = col(offset), col(length)
    near = F.when(n <= 18, 2).when(n < 18 + 256, 3)
    more = F.when(n <= 64, 0).when(n < 64 + 256, 1).when(n < 64 + 65536, 2).otherwise(3)
    far = F.when((o >= 64) & (o <= 65599), 3 + more).when((o >= 65536) & (o <= 2162687), 4 + more)
    return F.when(o <= 1024, F.least(F.coalesce(near, F.lit(99)), F.coalesce(far, F.lit(99)))).otherwise(far).cast("int")


def index_spacing(max_block) -> Column:
    """Least distance of index entries: the largest block, doubled until it is 1 MiB."""
    b = col(max_block).cast("double")
    return F.when(b <= 0, F.lit(None)).otherwise(b * F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.lit(float(1 << 20)) / b)), F.lit(0)))).cast("long")


def padding(total, multiple) -> Column:
    """Bytes a padding chunk takes so that a total becomes a multiple: none, or 4 (its header) and more."""
    gap = F.pmod(-col(total).cast("long"), F.lit(multiple))
    lack = F.greatest(F.ceil((F.lit(4) - gap) / F.lit(float(multiple))), F.lit(0)).cast("long")
    return F.when(F.lit(multiple) <= 1, F.lit(0)).when(gap == 0, F.lit(0)).otherwise(gap + lack * multiple).cast("long")


def le_bytes(n, width: int) -> Column:
    """A number's low bytes, the lowest first, as BINARY."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(col(n).cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def chunk_header(kind: int, length) -> Column:
    """A chunk's first four bytes: its type and its length."""
    return F.concat(F.unhex(F.lit(f"{kind:02X}")), le_bytes(length, 3))


def block_len(block) -> Column:
    """The decoded length of a block by its header: null if it is no block (its first byte is not 0), -1 if malformed.

    A block is a zero byte alone (nothing), or one, a length and a body; a length of 0 means that the body is the bytes.
    """
    b = col(block)
    size, total = F.octet_length(b).cast("long"), uvarint_value(F.substring(b, 2, 10))
    body = size - 1 - uvarint_len(total)
    coded = F.when((total > MAX_BLOCK) | (body < 1) | (body > total), -1).otherwise(total)
    kind = F.when(size == 1, 0).when(total.isNull(), -1).when(total == 0, F.when(body > 0, body).otherwise(-1)).otherwise(coded)
    return F.when(F.hex(F.substring(b, 1, 1)) == "00", kind).cast("long")


def option_errors(block_size, multiple, max_user_chunk=1 << 24) -> Column:
    """Why a writer refuses its options: block size from 4 KiB to 8 MiB, padding from 1 to 4 MiB; null if it does not."""
    b, p = col(block_size), col(multiple)
    return F.when((b < 4096) | (b > MAX_BLOCK), "block size").when((p < 1) | (p > 4 << 20), "padding")
