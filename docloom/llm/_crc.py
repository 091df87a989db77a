"""CRC-32 in DuckDB, which has no function for it: the table of steps by rule, and the sum byte by byte."""

from __future__ import annotations

#: A CTE ``steps(t)`` of one row.
STEPS = """steps as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by i) as t
  from range(256) r(i))"""


def of_hex(h: str) -> str:
    """The checksum of bytes that are given in hexadecimal, where ``t`` of ``steps`` is in scope."""
    data = f"list_transform(range(len({h}) // 2), lambda k: ('0x' || {h}[2 * k + 1:2 * k + 2])::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint)"
