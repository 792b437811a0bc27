"""SQL building blocks of the oracles: the same definitions, written for another engine."""

from __future__ import annotations

#: Bases of a text.
BASES = "upper(regexp_replace(coalesce(text,''), '[^ACGTacgt]', '', 'g'))"


def seqs(name: str = "b", table: str = "documents", id_col: str = "doc_id") -> str:
    return f"{name} AS (SELECT {id_col} AS seq_id, {BASES} AS seq FROM {table})"


def _code(j: int) -> str:
    return f"(CAST(instr('ACGT', substr(seq, pos+{j + 1}, 1)) AS BIGINT)-1)"


def le_code(k: int) -> str:
    return "+".join(f"{_code(j)}*{4**j}" for j in range(k))


def le_reverse(k: int) -> str:
    return "+".join(f"(3-{_code(j)})*{4 ** (k - 1 - j)}" for j in range(k))


def kmers(out: str, src: str, k: int, span: int | None = None) -> str:
    """Places of all k-mers with both codes (of at most 16 bases)."""
    n = min(k, 16)
    return (f"{out}_p AS (SELECT seq_id, seq, length(seq) AS len, unnest(range(0, length(seq)-{k}+1)) AS pos FROM {src} WHERE length(seq) >= {k}), "
            f"{out} AS (SELECT seq_id, len, pos, {le_code(n)} AS f, {le_reverse(n)} AS r FROM {out}_p)")


def hashes(out: str, src: str, canonical: bool = True) -> str:
    x = "least(f, r)" if canonical else "f"
    return (f"{out}_1 AS (SELECT seq_id, len, pos, xor({x}, {x} >> 13) AS x FROM {src}), "
            f"{out}_2 AS (SELECT seq_id, len, pos, ((x*51819)+(((x*34283)&65535)*65536))&4294967295 AS x FROM {out}_1), "
            f"{out} AS (SELECT seq_id, len, pos, xor(x, x >> 16) AS h FROM {out}_2)")


def minimizers(out: str, src: str, k: int, w: int, canonical: bool = True) -> str:
    win = f"(PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    return (kmers(out + "_k", src, k) + ", " + hashes(out + "_h", out + "_k", canonical) + ", "
            f"{out}_m AS (SELECT seq_id, pos, len, min((h >> 8)*4294967296 + pos) OVER {win} AS m FROM {out}_h), "
            f"{out} AS (SELECT DISTINCT seq_id, m & 4294967295 AS pos, (m >> 32)*256 AS hash FROM {out}_m WHERE pos + {k + w - 1} <= len)")


def syncmers(out: str, src: str, k: int, s: int, t: int = 0, closed: bool = True, strict: bool = False, canonical: bool = True) -> str:
    w = k - s + 1
    win = f"(PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    by = "(PARTITION BY seq_id ORDER BY pos)"
    if strict:
        pick = f"arg_min(pos, h*1048576 + (pos % 1048576)) OVER {win} - pos = {w // 2}"
        cols = f"min((h*1048576)::HUGEINT*1048576 + pos) OVER {win} % 1099511627776::HUGEINT % 1048576 AS best"
        return (kmers(out + "_k", src, s) + ", " + hashes(out + "_h", out + "_k", canonical) + ", "
                f"{out}_m AS (SELECT seq_id, pos, len, CAST(min(CAST(h AS HUGEINT)*4294967296 + pos) OVER {win} % 4294967296 AS BIGINT) AS best FROM {out}_h), "
                f"{out} AS (SELECT seq_id, pos FROM {out}_m WHERE pos + {k} <= len AND best - pos = {w // 2})")
    at = "h" if t == 0 else f"lead(h, {t}) OVER {by}"
    end = f" OR e = m" if closed else ""
    return (kmers(out + "_k", src, s) + ", " + hashes(out + "_h", out + "_k", canonical) + ", "
            f"{out}_m AS (SELECT seq_id, pos, len, {at} AS a, lead(h, {w - 1}) OVER {by} AS e, min(h) OVER {win} AS m FROM {out}_h), "
            f"{out} AS (SELECT seq_id, pos FROM {out}_m WHERE pos + {k} <= len AND (a = m{end}))")


def masked_hash(out: str, src: str, col: str, k: int, keep: str) -> str:
    """Adds ``key``: the invertible hash of a 2k-bit column, one step a table."""
    m = (1 << 2 * k) - 1

    def left(n):
        return f"((x & {m >> n}) << {n})"

    steps = [f"({m} - {col} + (({col} & {m >> 21}) << 21)) & {m}", "xor(x, x >> 24)", f"(x + {left(3)} + {left(8)}) & {m}", "xor(x, x >> 14)",
             f"(x + {left(2)} + {left(4)}) & {m}", "xor(x, x >> 28)", f"(x + {left(31)}) & {m}"]
    parts, prev = [], src
    for i, e in enumerate(steps):
        name = out if i == len(steps) - 1 else f"{out}_s{i}"
        parts.append(f"{name} AS (SELECT {keep}, {e} AS {'key' if i == len(steps) - 1 else 'x'} FROM {prev})")
        prev = name
    return ", ".join(parts)


def seeds(out: str, src: str, k: int = 15, w: int = 11) -> str:
    """seq_id, key, span, pos (last base), strand of minimizers."""
    return (minimizers(out + "_m", src, k, w) + ", "
            f"{out}_c AS (SELECT m.seq_id, m.pos + {k - 1} AS pos, least(f, r) AS c, CAST(r < f AS INT) AS strand FROM {out}_m m JOIN {out}_m_k k ON m.seq_id = k.seq_id AND m.pos = k.pos), "
            + masked_hash(out, out + "_c", "c", k, f"seq_id, {k} AS span, pos, strand"))
