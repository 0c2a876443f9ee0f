"""SQL forms of the hash kernels and of MinHash sketches, for comparison only.

64-bit products are taken modulo 2^64 in 128-bit integers, one 32-bit half of the constant at a time.
"""

from __future__ import annotations

P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
M, HALF = 1 << 64, 1 << 32


def times(x: str, k: int) -> str:
    return f"((({x}) * {k % HALF}::HUGEINT + ((({x}) * {k // HALF}::HUGEINT) % {HALF}) * {HALF}) % {M})"


def turned(x: str, n: int) -> str:
    return f"((({x}) * {1 << n}::HUGEINT) % {M} + ({x}) // {1 << 64 - n}::HUGEINT)"


def _turn(x: int, n: int) -> int:
    return (x << n | x >> 64 - n) % M


def _mixed(cte: str, source: str, x: str) -> str:
    """CTEs after which ``cte`` has the columns of ``source`` and ``h``, the finished hash of its column ``x``."""
    shift = lambda c, n: f"xor(CAST({c} AS UBIGINT), CAST({c} AS UBIGINT) >> {n})::HUGEINT"
    return f"""{cte}_1 AS (SELECT *, {shift(x, 33)} AS h1 FROM {source}),
{cte}_2 AS (SELECT *, {times('h1', P2)} AS h2 FROM {cte}_1),
{cte}_3 AS (SELECT *, {shift('h2', 29)} AS h3 FROM {cte}_2),
{cte}_4 AS (SELECT *, {times('h3', P3)} AS h4 FROM {cte}_3),
{cte} AS (SELECT * EXCLUDE (h1, h2, h3, h4), {shift('h4', 32)} AS h FROM {cte}_4)"""


def _word(x: str, at: str, size: int) -> str:
    """The little-endian word of ``size`` bytes whose first hex digit is at place ``at`` of ``x``."""
    return f"CAST('0x' || {' || '.join(f'substr({x}, {at} + {2 * i}, 2)' for i in reversed(range(size)))} AS UBIGINT)"


def h64(source: str, seed: int = 0, name: str = "hashed") -> str:
    """CTEs whose last, ``name``, has the columns of ``source`` (x: hex of the bytes) and ``h``."""
    lanes = [(seed + P1 + P2) % M, (seed + P2) % M, seed, (seed - P1) % M]
    step = times(turned(f"((a + v) % {M})", 31), P1)
    columns = ", ".join(f"list_reduce(list_prepend({s}::HUGEINT, [w[i] for i in range({k + 1}, len(w) + 1, 4)]), lambda a, v: {step}) AS l{k}" for k, s in enumerate(lanes))
    ends = " + ".join(turned(f"l{k}", n) for k, n in enumerate((1, 7, 12, 18)))
    n = name
    return f"""{n}_p AS (SELECT *, length(x) // 2 AS n_bytes, rpad(x, CAST((length(x) + 63) // 64 * 64 AS INTEGER), '0') AS y FROM {source}),
{n}_w AS (SELECT *, list_transform(range(0, length(y) // 16), lambda i: {times(_word('y', 'i * 16 + 1', 8) + '::HUGEINT', P2)}) AS w FROM {n}_p),
{n}_l AS (SELECT * EXCLUDE (w, y), {columns} FROM {n}_w),
{n}_s AS (SELECT * EXCLUDE (n_bytes, l0, l1, l2, l3), (n_bytes + {ends}) % {M} AS s FROM {n}_l),
{_mixed(n, n + '_s', 's')}"""


def _crc_table() -> str:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(f"{i:08x}")
    return "".join(out)


def crc32c(source: str) -> str:
    """CTEs whose last, ``hashed``, has the columns of ``source`` (x: hex of the bytes) and ``h``."""
    byte = "CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT)"
    step = f"xor(a >> 8, CAST('0x' || substr('{_crc_table()}', CAST((xor(a, v) & 255) * 8 + 1 AS BIGINT), 8) AS UBIGINT))"
    return f"""listed AS (SELECT *, list_prepend({HALF - 1}::UBIGINT, list_transform(range(0, length(x) // 2), lambda i: {byte})) AS b FROM {source}),
hashed AS (SELECT * EXCLUDE (b), xor(list_reduce(b, lambda a, v: {step}), {HALF - 1}::UBIGINT) AS h FROM listed)"""


def xxh32(source: str) -> str:
    """CTEs whose last, ``hashed``, has the columns of ``source`` (x: hex of the bytes) and ``h``; seed 0."""
    q1, q2, q3, q4, q5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
    cut, turn = (lambda x: f"(({x}) & {HALF - 1})"), (lambda x, n: f"(((({x}) << {n}) & {HALF - 1}) | (({x}) >> {32 - n}))")
    by = lambda x, k: cut(f"({x}) * {k}::UBIGINT")
    lanes = [(q1 + q2) % HALF, q2, 0, (-q1) % HALF]
    step = by(turn(cut("a + v"), 13), q1)
    columns = ", ".join(f"list_reduce(list_prepend({s}::UBIGINT, [{by('w[i]', q2)} for i in range({k + 1}, n_bytes // 16 * 4 + 1, 4)]), lambda a, v: {step}) AS l{k}" for k, s in enumerate(lanes))
    whole = cut(" + ".join(turn(f"l{k}", n) for k, n in enumerate((1, 7, 12, 18))))
    words = f"[{by('w[i]', q3)} for i in range(n_bytes // 16 * 4 + 1, n_bytes // 4 + 1)]"
    rest = f"[{by('b[i]', q5)} for i in range(n_bytes // 4 * 4 + 1, n_bytes + 1)]"
    xs = lambda x, n: f"xor({x}, {x} >> {n})"
    return f"""sized AS (SELECT *, length(x) // 2 AS n_bytes FROM {source}),
split AS (SELECT *, list_transform(range(0, n_bytes // 4), lambda i: {_word('x', 'i * 8 + 1', 4)}) AS w, list_transform(range(0, n_bytes), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT)) AS b FROM sized),
laned AS (SELECT *, {columns} FROM split),
begun AS (SELECT *, {cut(f"CASE WHEN n_bytes >= 16 THEN {whole} ELSE {q5} END + n_bytes")} AS s FROM laned),
mid AS (SELECT *, list_reduce(list_prepend(CAST(s AS UBIGINT), {words}), lambda a, v: {by(turn(cut('a + v'), 17), q4)}) AS s2 FROM begun),
tail AS (SELECT *, list_reduce(list_prepend(s2, {rest}), lambda a, v: {by(turn(cut('a + v'), 11), q1)}) AS s3 FROM mid),
m1 AS (SELECT *, {by(xs('s3', 15), q2)} AS s4 FROM tail), m2 AS (SELECT *, {by(xs('s4', 13), q3)} AS s5 FROM m1),
hashed AS (SELECT * EXCLUDE (w, b, l0, l1, l2, l3), {xs('s5', 16)} AS h FROM m2)"""


def sketches(source: str, key: str, num_hashes: int, bits: int, seed: int = 42, name: str = "sketch") -> str:
    """CTEs whose last, ``name``, has (key, i, v): lane i of the MinHash of ``source`` (key, x: hex of the bytes)."""

    def word_hash(cte: str, of: str, s: int) -> str:
        rest = sum(_turn(_turn((s + k) % M, 31) * P1 % M, n) for k, n in ((P2, 7), (0, 12), (-P1, 18))) % M
        lane = times(turned(f"(({(s + P1 + P2) % M}::HUGEINT + wp) % {M})", 31), P1)
        return f"{cte}_0 AS (SELECT *, {lane} AS l FROM {of}), {cte}_s AS (SELECT * EXCLUDE (l), ({8 + rest}::HUGEINT + {turned('l', 1)}) % {M} AS s FROM {cte}_0), {_mixed(cte, cte + '_s', 's')}"

    n = name
    cut = f"CAST(v % {1 << bits}::HUGEINT AS UBIGINT)"
    return f"""{n}_w AS (SELECT DISTINCT {key}, unnest(list_transform(range(0, length(x) // 2 - 7), lambda i: {_word('x', 'i * 2 + 1', 8)})) AS w FROM {source}),
{n}_p AS (SELECT {key}, {times('w::HUGEINT', P2)} AS wp FROM {n}_w),
{word_hash(n + '_a', n + '_p', seed)},
{n}_b0 AS (SELECT {key}, wp, h AS ha FROM {n}_a),
{word_hash(n + '_b', n + '_b0', seed + 1)},
{n}_few AS (SELECT {key}, x FROM {source} WHERE length(x) BETWEEN 1 AND 15),
{h64(n + '_few', seed, n + '_c')},
{n}_d0 AS (SELECT {key}, x, h AS ha FROM {n}_c),
{h64(n + '_d0', seed + 1, n + '_d')},
{n}_i AS (SELECT range AS i FROM range(0, {num_hashes})),
{n}_all AS (SELECT {key}, i, min((ha + i * h) % {M}) AS v FROM (SELECT {key}, ha, h FROM {n}_b UNION ALL SELECT {key}, ha, h FROM {n}_d), {n}_i GROUP BY ALL
  UNION ALL SELECT {key}, i, {M - 1}::HUGEINT FROM {source}, {n}_i WHERE x = ''),
{n} AS (SELECT {key}, i, {cut} AS v FROM {n}_all)"""
