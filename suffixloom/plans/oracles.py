"""DuckDB SQL for the registered queries, put together from common table expressions.

Written from the definitions and not from the plans: strings are unnested, contexts found by
recursion-free suffix lists, and nothing of the DataFrame code is used but the parameters.
"""

from __future__ import annotations

from ..config import ALPHABET
from . import queries as q

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MAPPED = "".join(ALPHABET[i % 26 % 4] for i in range(52))
_NEXT = "n_a, n_c, n_g, n_t"


def _kmers(k: int, by: str = "lang", table: str = "documents", squeeze: bool = True, name: str = "km") -> str:
    """CTEs ``fr`` (fragments) and ``km`` (by, kmer, count)."""
    text = f"translate(coalesce(text, ''), '{_LETTERS}', '{_MAPPED}')"
    runs = f"[regexp_replace({text}, '[^ACGT]', '', 'g')]" if squeeze else f"regexp_split_to_array({text}, '[^ACGT]+')"
    key = f"{by}, " if by else ""
    return (
        f"{name}_fr AS (SELECT {key}f FROM (SELECT {key}unnest({runs}) AS f FROM {table}) WHERE length(f) >= {k}),\n"
        f"{name} AS (SELECT {key}kmer, count(*) AS count FROM (SELECT {key}unnest(list_transform(range(1, length(f) - {k} + 2), lambda i: substr(f, i, {k}))) AS kmer FROM {name}_fr) GROUP BY ALL)"
    )


def _contexts(depth: int, by: str = "lang", kmers: str = "km", name: str = "cx") -> str:
    """CTE ``cx`` (by, context, depth, n_*, count): sums over all prefixes."""
    sums = ", ".join(f"CAST(sum(CASE WHEN nx = '{s}' THEN count ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ALPHABET)
    return (
        f"{name} AS (SELECT {by}, context, CAST(length(context) AS INTEGER) AS depth, {sums}, CAST(sum(count) AS BIGINT) AS count FROM "
        f"(SELECT {by}, substr(kmer, 1, d) AS context, substr(kmer, d + 1, 1) AS nx, count FROM {kmers}, range(0, {depth + 1}) r(d)) GROUP BY {by}, context)"
    )


def _adjust(build, depth: str = "depth") -> str:
    s = build.sequencing
    return f"({s.depth} * pow({1 - s.error_rate}, {depth}))" if s.adjust else "1.0"


def _support(build, contexts: str = "cx", name: str = "sp", enough: str | None = None) -> str:
    return f"{name} AS (SELECT * FROM {contexts} WHERE depth = 0 OR {enough or f'count >= {build.min_count} * {_adjust(build)}'})"


def _close(by: str = "lang", supported: str = "sp", name: str = "cl") -> str:
    """CTE ``cl``: no proper suffix is missing."""
    key = " AND ".join(f"p.{b} = x.{b}" for b in by.split(", "))
    return (
        f"{name} AS (SELECT * FROM {supported} w WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {', '.join('y.' + b for b in by.split(', '))}, y.context AS whole "
        f"FROM {supported} y, range(1, 10) r(d) LEFT JOIN {supported} p ON {key.replace('x.', 'y.')} AND p.context = right(y.context, d) "
        f"WHERE d < y.depth AND p.context IS NULL) z WHERE {' AND '.join(f'z.{b} = w.{b}' for b in by.split(', '))} AND z.whole = w.context))"
    )


def _p(s: str, alias: str, a: float = 1.0) -> str:
    return f"(({alias}.n_{s} + {a}) / ({alias}.n_a + {alias}.n_c + {alias}.n_g + {alias}.n_t + {4 * a}))"


def _kl() -> str:
    return "c.count * (" + " + ".join(f"{_p(s, 'c')} * ln({_p(s, 'c')} / {_p(s, 'p')})" for s in "acgt") + ")"


def _ps() -> str:
    return "greatest(0.0, " + ", ".join(f"({_p(s, 'c')} - {_p(s, 'p')}) * c.count" for s in "acgt") + ")"


def _edges(build, by: str = "lang", contexts: str = "cl", name: str = "ed", least: str | None = None, divergence: str | None = None) -> str:
    peres = build.estimator == q.PERES_SHIELDS
    on = " AND ".join(f"p.{b} = c.{b}" for b in by.split(", "))
    root = f" JOIN {contexts} r ON {on.replace('p.', 'r.')} AND r.depth = 0" if peres else ""
    limit = f"pow(r.count, 0.75) * {_adjust(build, 'c.depth')}" if peres else f"{least or build.threshold} * {_adjust(build, 'c.depth')}"
    keys = ", ".join(f"c.{b} AS {b}" for b in by.split(", "))
    return (
        f"{name} AS (SELECT {keys}, c.context, p.context AS parent, c.depth, {divergence or (_ps() if peres else _kl())} AS raw_divergence, CAST({limit} AS DOUBLE) AS least "
        f"FROM {contexts} c JOIN {contexts} p ON {on} AND p.context = substr(c.context, 2){root} WHERE c.depth >= 1)"
    )


def _tree(by: str = "lang", contexts: str = "cl", edges: str = "ed", kept: str = "kp", name: str = "tr") -> str:
    """CTEs ``kp`` (kept contexts but the root) and ``tr`` (the tree)."""
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in by.split(", "))
    return (
        f"{kept} AS (SELECT DISTINCT {by}, right(context, d) AS context FROM {edges}, range(1, 10) r(d) WHERE raw_divergence >= least AND d <= depth),\n"
        f"{name}_ch AS (SELECT {by}, substr(context, 2) AS context, count(*) AS n FROM {kept} GROUP BY ALL),\n"
        f"{name} AS (SELECT {', '.join('x.' + b for b in by.split(', '))}, x.context, x.depth, x.n_a, x.n_c, x.n_g, x.n_t, x.count, "
        f"CASE WHEN x.depth = 0 OR coalesce(h.n, 0) > 0 THEN -1.0 ELSE e.raw_divergence END AS divergence, x.depth > 0 AND coalesce(h.n, 0) < 4 AS is_terminal "
        f"FROM {contexts} x LEFT JOIN {kept} k ON {on('x', 'k')} AND x.context = k.context LEFT JOIN {name}_ch h ON {on('x', 'h')} AND x.context = h.context "
        f"LEFT JOIN {edges} e ON {on('x', 'e')} AND x.context = e.context WHERE x.depth = 0 OR k.context IS NOT NULL)"
    )


def _whole(build=q.TREE_BUILD, by: str = "lang", table: str = "documents") -> str:
    return ",\n".join([_kmers(build.k, by, table), _contexts(build.max_depth, by), _support(build), _close(by), _edges(build, by), _tree(by)])


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_R = q.DIGITS
_TREE_COLUMNS = f"context, depth, {_NEXT}, count, round(divergence, {_R}) AS divergence, is_terminal"
_EDGE_COLUMNS = f"lang, context, parent, depth, round(raw_divergence, {_R}) AS raw_divergence, round(least, {_R}) AS least"


def _components(order: int, by: str = "lang", tree: str = "tr", name: str = "cp") -> str:
    vs = ", ".join(f"{_p(s, 'x')} / sqrt({_p(s, 'b')}) AS v_{s}" for s in "acgt")
    return (
        f"{name}_b AS (SELECT x.{by}, x.context, max(b.depth) AS bd FROM {tree} x JOIN {tree} b ON x.{by} = b.{by} AND b.depth <= least({order}, x.depth) AND b.context = right(x.context, b.depth) GROUP BY ALL),\n"
        f"{name} AS (SELECT x.{by}, x.context, x.depth, {vs} FROM {tree} x JOIN {name}_b z USING ({by}, context) JOIN {tree} b ON x.{by} = b.{by} AND b.depth = z.bd AND b.context = right(x.context, z.bd))"
    )


def _distances(order: int, where: str = "l.lang < r.lang") -> str:
    dot = lambda a, b: " + ".join(f"{a}.v_{s} * {b}.v_{s}" for s in "acgt")
    used = lambda x: f"sum(CASE WHEN l.depth > {order} THEN {x} ELSE 0 END)"
    return (
        f"ds AS (SELECT l.lang AS left_id, r.lang AS right_id, count(*) AS n_both, CAST({used('1')} AS BIGINT) AS n_shared, {used(dot('l', 'r'))} AS d, {used(dot('l', 'l'))} AS ll, {used(dot('r', 'r'))} AS rr "
        f"FROM cp l JOIN cp r ON l.context = r.context AND {where} GROUP BY ALL),\n"
        f"sz AS (SELECT lang, count(*) AS n FROM tr GROUP BY lang),\n"
        f"dd AS (SELECT left_id, right_id, n_shared, a.n + b.n - 2 * n_both AS n_missing, CASE WHEN ll > 0 AND rr > 0 THEN 2 * acos(least(1.0, greatest(-1.0, d / sqrt(ll * rr)))) / pi() ELSE 1.0 END AS distance "
        f"FROM ds JOIN sz a ON a.lang = left_id JOIN sz b ON b.lang = right_id)"
    )


_PENALIZED = "0.75 * distance + 0.25 * coalesce(n_missing / nullif(CAST(n_missing + n_shared AS DOUBLE), 0), 0)"
_DISTANCES = f"SELECT left_id, right_id, n_shared, n_missing, round(distance, {_R}) AS distance, round({_PENALIZED}, {_R}) AS penalized FROM dd"


def _scored(depth: int, kmers: str, tree: str = "tr", by: str = "lang", on: str = "", name: str = "sc") -> str:
    """CTE ``sc`` (by, kmer, count, context, lp): the longest context before each k-mer's last symbol."""
    cases = " ".join(f"WHEN '{s}' THEN ln({_p(s.lower(), 't')})" for s in ALPHABET)
    return (
        f"{name} AS (SELECT * FROM (SELECT {', '.join('t.' + b for b in by.split(', '))}, k.kmer, k.count, t.context, CASE right(k.kmer, 1) {cases} END AS lp, "
        f"row_number() OVER (PARTITION BY {', '.join('t.' + b for b in by.split(', '))}, k.kmer ORDER BY t.depth DESC) AS rn "
        f"FROM {kmers} k JOIN {tree} t ON t.context = right(substr(k.kmer, 1, {depth}), t.depth){on}) WHERE rn = 1)"
    )


_ALL = "(SELECT 0 AS lang, text FROM documents)"


def _bic(grid: dict = q.GRID, table: str = "documents") -> str:
    """CTE ``bg``: a grid of parameters."""
    parts, rows = [], []
    for d in range(3, grid["max_depth"]):
        build = q.Build(max_depth=d, min_count=1)
        by, full = "lang, min_count", "lang, min_count, threshold"
        parts += [
            _kmers(d + 1, table=table, name=f"km{d}"), _contexts(d, kmers=f"km{d}", name=f"cx{d}"),
            f"sp{d} AS (SELECT c.*, min_count FROM cx{d} c, (VALUES {', '.join(f'({m})' for m in grid['min_counts'])}) g(min_count) WHERE depth = 0 OR count >= min_count)",
            _close(by, f"sp{d}", f"cl{d}"), _edges(build, by, f"cl{d}", f"e{d}", "0"),
            f"ed{d} AS (SELECT lang, min_count, threshold, context, depth, raw_divergence, threshold AS least FROM e{d}, (VALUES {', '.join(f'({t}::DOUBLE)' for t in grid['thresholds'])}) h(threshold))",
            f"ct{d} AS (SELECT c.*, threshold FROM cl{d} c, (VALUES {', '.join(f'({t}::DOUBLE)' for t in grid['thresholds'])}) h(threshold))",
            _tree(full, f"ct{d}", f"ed{d}", f"kp{d}", f"tr{d}"), _scored(d, f"km{d}", f"tr{d}", full, " AND t.lang = k.lang", f"sc{d}"),
            f"tm{d} AS (SELECT {full}, 3 * count(*) FILTER (WHERE is_terminal) AS n_params, max(CASE WHEN depth = 0 THEN count END) AS n FROM tr{d} GROUP BY ALL)",
            f"ll{d} AS (SELECT {full}, sum(count * lp) AS log_likelihood FROM sc{d} GROUP BY ALL)",
        ]
        rows.append(f"SELECT {d} AS max_depth, {full}, n_params, log_likelihood, n_params * ln(n) - 2 * log_likelihood AS bic_score FROM tm{d} JOIN ll{d} USING ({full})")
    return ",\n".join([*parts, "bg AS (" + " UNION ALL ".join(rows) + ")"])


_T = q.TREE_BUILD
_CX = (_kmers(5), _contexts(4))
_DE_EN = "SELECT * FROM tr WHERE lang IN ('de', 'en')"

_GRID_ROWS = "SELECT lang, max_depth, min_count, threshold, n_params, round(log_likelihood, 3) AS log_likelihood, round(bic_score, 3) AS bic_score FROM bg"
_SPECTRUM = "SELECT lang, count, count(*) AS n_kmers FROM km GROUP BY lang, count"
_SQUEEZED = f"regexp_replace(translate(coalesce(text, ''), '{_LETTERS}', '{_MAPPED}'), '[^ACGT]', '', 'g')"

ORACLE_SQL = {
    "kmer_counts": _with(_kmers(5), select="SELECT * FROM km"),
    "kmer_counts_streamed": _with(_kmers(5), select="SELECT * FROM km"),
    "kmer_counts_split": _with(_kmers(4, squeeze=False), select="SELECT * FROM km"),
    "kmer_union_sum": _with(_kmers(5, "", name="a"), _kmers(5, "", "conversations", name="b"), select="SELECT kmer, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY kmer"),
    "sequence_fragments": _with(_kmers(4, squeeze=False), select="SELECT lang, count(*) AS n, CAST(sum(length(f)) AS BIGINT) AS symbols, CAST(sum(length(f) - 3) AS BIGINT) AS windows FROM km_fr GROUP BY lang"),
    "symbol_functions": _with(_kmers(5), select="""SELECT lang, kmer, left(kmer, 3) AS prefix3, substr(kmer, 2) AS suffix, right(kmer, 2) AS last2, 'T' || substr(kmer, 2) AS sibling,
        CAST(instr('ACGT', substr(kmer, 2, 1)) - 1 AS INTEGER) AS code1, CAST(16 * (instr('ACGT', substr(kmer, 1, 1)) - 1) + 4 * (instr('ACGT', substr(kmer, 2, 1)) - 1) + instr('ACGT', substr(kmer, 3, 1)) - 1 AS BIGINT) AS index3,
        CAST(coalesce(list_min(list_filter(range(0, 5), lambda i: substr(kmer, i + 1, 1) <> substr(reverse(kmer), i + 1, 1))), -1) AS INTEGER) AS differs,
        CAST(coalesce(list_min(list_filter(range(0, 4), lambda i: substr(kmer, i + 2, 1) <> substr('ACGTACGT', i + 2, 1))), -1) AS INTEGER) AS differs_skipped,
        CAST(341 AS BIGINT) AS n_contexts, CAST(6 AS INTEGER) AS n_suffixes FROM km"""),
    "context_counts": _with(*_CX, select="SELECT * FROM cx"),
    "context_rollup_check": _with(_kmers(4), _contexts(3), select="SELECT c.lang, c.context, c.count, CAST(sum(x.count) AS BIGINT) AS below FROM cx c JOIN cx x ON x.lang = c.lang AND x.depth = c.depth + 1 AND left(x.context, c.depth) = c.context GROUP BY ALL"),
    "context_support": _with(*_CX, _support(_T), select="SELECT * FROM sp"),
    "context_support_adjusted": _with(*_CX, _support(q.ADJUSTED), select="SELECT * FROM sp"),
    "context_closure": _with(*_CX, _support(q.ADJUSTED), _close(), select="SELECT * FROM cl"),
    "context_orphans": _with(*_CX, _support(q.ADJUSTED), _close(), select="SELECT lang, context, depth, count FROM sp WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.lang = sp.lang AND cl.context = sp.context)"),
    "context_post_order": _with(*_CX, _support(_T), _close(), select="SELECT lang, context, CAST(row_number() OVER (PARTITION BY lang ORDER BY reverse(context) DESC) AS INTEGER) AS place FROM cl"),
    "next_symbol_probs": _with(*_CX, _support(_T), _close(), select="SELECT lang, context, " + ", ".join(f"round({_p(s, 'cl')}, {_R}) AS p_{s}" for s in "acgt") + " FROM cl"),
    "edges_kl": _with(*_CX, _support(_T), _close(), _edges(_T), select=f"SELECT {_EDGE_COLUMNS} FROM ed"),
    "edges_peres_shields": _with(*_CX, _support(q.PS_BUILD), _close(), _edges(q.PS_BUILD), select=f"SELECT {_EDGE_COLUMNS} FROM ed"),
    "contexts_kept": _with(_whole(), select="SELECT * FROM kp"),
    "tree_kl": _with(_whole(), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_peres_shields": _with(_whole(q.PS_BUILD), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_maintained": _with(_whole(), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_maintained_peres_shields": _with(_whole(q.PS_BUILD), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_kl_adjusted": _with(_whole(q.ADJUSTED), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_by_role": _with(_whole(by="role", table="conversations"), select=f"SELECT role, {_TREE_COLUMNS} FROM tr"),
    "tree_reprune": _with(_whole(q.Build(max_depth=4, min_count=_T.min_count, threshold=q.HARDER)), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_dump": _with(_whole(), select="SELECT lang, concat_ws(' ', context, count, n_a, n_c, n_g, n_t, CAST(round(divergence, 0) AS BIGINT), CAST(is_terminal AS INTEGER), 0) AS line FROM tr"),
    "tree_archive": _with(_whole(), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_size": _with(_whole(), select="SELECT lang, CAST(coalesce(sum(depth) FILTER (WHERE is_terminal), 0) AS BIGINT) AS terminal_length, CAST(coalesce(sum(count) FILTER (WHERE depth = 1), 0) AS BIGINT) AS sequence_size FROM tr GROUP BY lang"),
    "tree_terminals": _with(_whole(), select="SELECT lang, count(*) FILTER (WHERE is_terminal) AS n_terminal, max(count) FILTER (WHERE depth = 0) AS sequence_size FROM tr GROUP BY lang"),
    "tree_remainder": _with(_whole(), select="SELECT t.lang, t.context, t.count, CAST(greatest(t.count - coalesce((SELECT sum(c.count) FROM tr c WHERE c.lang = t.lang AND c.depth = t.depth + 1 AND substr(c.context, 2) = t.context), 0), 0) AS BIGINT) AS remainder FROM tr t"),
    "shared_contexts": _with(_whole(), select=f"SELECT context, bool_or(lang = 'de') AS in_left, bool_or(lang = 'en') AS in_right FROM ({_DE_EN}) GROUP BY context"),
    "background_components": _with(_whole(), _components(0), select="SELECT lang, context, depth, " + ", ".join(f"round(v_{s}, {_R}) AS v_{s}" for s in "acgt") + " FROM cp"),
    "background_components_order1": _with(_whole(), _components(1), select="SELECT lang, context, depth, " + ", ".join(f"round(v_{s}, {_R}) AS v_{s}" for s in "acgt") + " FROM cp"),
    "distance": _with(_whole(), _components(0), _distances(0, "l.lang = 'de' AND r.lang = 'en'"), select=f"SELECT n_shared, round(distance, {_R}) AS distance FROM dd"),
    "distance_penalized": _with(_whole(), _components(0), _distances(0, "l.lang = 'de' AND r.lang = 'en'"), select=f"SELECT n_shared, n_missing, round({_PENALIZED}, {_R}) AS penalized FROM dd"),
    "distance_measures": _with(
        _whole(), _components(0), _distances(0, "l.lang = 'de' AND r.lang = 'en'"),
        "jc AS (SELECT count(*) FILTER (a.context IS NOT NULL AND b.context IS NOT NULL) / CAST(count(*) AS DOUBLE) AS jaccard, "
        "sum(coalesce(least(a.count + 0 * b.count, b.count + 0 * a.count), 0)) / CAST(sum(greatest(coalesce(a.count, 0), coalesce(b.count, 0))) AS DOUBLE) AS weighted_jaccard "
        "FROM (SELECT * FROM tr WHERE lang = 'de') a FULL JOIN (SELECT * FROM tr WHERE lang = 'en') b ON a.context = b.context)",
        select=f"SELECT n_shared, n_missing, round(distance, {_R}) AS distance, round({_PENALIZED}, {_R}) AS penalized, round(jaccard, {_R}) AS jaccard, round(weighted_jaccard, {_R}) AS weighted_jaccard FROM dd, jc",
    ),
    "distance_matrix": _with(_whole(), _components(0), _distances(0), select=_DISTANCES),
    "distance_order1": _with(_whole(), _components(1), _distances(1), select=_DISTANCES),
    "score_nll": _with(_whole(), _kmers(_T.k, "", "benchmark", name="bm"), _scored(_T.max_depth, "bm"), select=f"SELECT lang, CAST(sum(count) AS BIGINT) AS n_windows, round(sum(count * lp), {_R}) AS log_likelihood, round(-sum(count * lp) / sum(count), {_R}) AS nll FROM sc GROUP BY lang"),
    "score_documents": _with(
        _whole(), _kmers(_T.k, "doc_id", name="dk"), "ks AS (SELECT kmer, 1 AS count FROM dk GROUP BY kmer)", _scored(_T.max_depth, "ks"),
        select=f"SELECT doc_id, lang, CAST(sum(dk.count) AS BIGINT) AS n_windows, round(-sum(dk.count * lp) / sum(dk.count), {_R}) AS nll FROM dk JOIN sc ON dk.kmer = sc.kmer GROUP BY ALL",
    ),
    "score_longest_context": _with(_whole(), _scored(_T.max_depth, "km", on=" AND t.lang = k.lang"), select="SELECT lang, kmer, count, context FROM sc"),
    "bic_grid": _with(_bic(), select=_GRID_ROWS),
    "bic_grid_full": _with(_bic(q.FULL_GRID), select=_GRID_ROWS),
    "grid_csv": _with(_bic(table=_ALL), select=_GRID_ROWS.replace("lang, ", "")),
    "kmer_spectrum_12": _with(_kmers(12), select=_SPECTRUM),
    "kmer_spectrum_28": _with(_kmers(28), select=_SPECTRUM),
    "tree_depth9": _with(_whole(q.DEEP), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_own_rules": _with(
        *_CX, _support(q.OWN, enough=f"count >= {q.OWN.min_count} * CASE WHEN depth < 4 THEN 1 ELSE 5 END"), _close(),
        _edges(q.OWN, divergence="c.count * (" + " + ".join(f"abs({_p(s, 'c')} - {_p(s, 'p')})" for s in "acgt") + ") / 2"), _tree(), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "fasta_files": f"SELECT CAST(doc_id AS VARCHAR) AS seq_id, coalesce(lang, '') AS description, length({_SQUEEZED}) AS n, md5({_SQUEEZED}) AS digest FROM documents",
    "fastq_files": f"SELECT CAST(doc_id AS VARCHAR) AS seq_id, coalesce(lang, '') AS description, length({_SQUEEZED}) AS n, md5({_SQUEEZED}) AS digest, length({_SQUEEZED}) AS n_marks FROM documents",
    "fasta_kmers": _with(_kmers(5, table="(SELECT coalesce(lang, '') AS lang, text FROM documents)"), select="SELECT * FROM km"),
    "kmer_table": _with(_kmers(5), select="SELECT * FROM km"),
    "tree_table": _with(_whole(), select=f"SELECT lang, {_TREE_COLUMNS} FROM tr"),
    "tree_archive_file": _with(_whole(table=_ALL), select=f"SELECT {_TREE_COLUMNS} FROM tr"),
    "tree_dump_file": _with(_whole(table=_ALL), select="SELECT concat_ws(' ', context, count, n_a, n_c, n_g, n_t, printf('%.6g', divergence), CAST(is_terminal AS INTEGER), 0) AS line FROM tr"),
    "command_line": _with(_whole(q.Build(max_depth=4, min_count=_T.min_count, threshold=q.HARDER), table=_ALL), select=f"SELECT {_TREE_COLUMNS} FROM tr"),
    "bic_best": _with(_bic(), select="SELECT lang, max_depth, min_count, threshold, n_params FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY bic_score, max_depth, min_count, threshold) AS rn FROM bg) WHERE rn = 1"),
}
