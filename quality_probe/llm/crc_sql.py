"""CRC-32 in DuckDB SQL, for the statements of queries that draw by it."""

POLYNOMIAL = 0xEDB88320  # fixed value
ALL_ONES = 0xFFFFFFFF

# A common table expression with the register's values for each byte.
CRC_TABLE = f"""crc_table AS (
    SELECT list(entry ORDER BY i) AS entries FROM (
        SELECT i, list_reduce(
            range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, i
        ) AS entry
        FROM range(256) AS bytes(i)
    )
)"""


def crc32(text: str) -> str:
    """The CRC-32 of the UTF-8 bytes of an expression whose characters lie below U+0800; next to `crc_table`."""
    letters = f"string_split({text}, '')"
    utf8 = "CASE WHEN ord(a) < 128 THEN [ord(a)::BIGINT] ELSE [192 + (ord(a)::BIGINT >> 6), 128 + (ord(a)::BIGINT & 63)] END"
    codes = f"flatten(list_transform({letters}, lambda a: {utf8}))"
    step = "xor(c >> 8, entries[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, {ALL_ONES}), {ALL_ONES})"
