"""Registered queries of the engine: each operator over whole tables, models by language or role.

Sequences are the texts of ``documents`` (letters mapped to ACGT by their place in the alphabet modulo 4).
``SQUEEZED`` queries drop other characters, ``SPLIT`` ones take each word as a fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PERES_SHIELDS, Build, Sequencing
from ..functions.estimators import SYMBOLS, probabilities
from ..functions.symbols import all_suffixes, contexts_up_to, first_difference, last, prefix, prefix_index, replace_first, suffix, symbol_code
from ..operators import contexts as C
from ..operators import kmers as K
from ..operators import metrics as M
from ..operators import prune as P
from ..operators.walks import score_each
from ..sources.sequences import as_symbols, from_text, read_fasta, read_fasta_pieces, read_fastq, read_kmers, write_fasta, write_fastq
from ..sources.archives import read_archive, write_archive
from ..sources.trees import dump, dump_line, from_records, read_tree, to_records, write_grid, write_tree
from ..streaming.incremental import count_stream, current_counts
from ..streaming.maintained import MaintainedTree
from ..tables import shared_dir, small, written
from .build import bic_sequences, contexts_from_kmers, tree_from_kmers, tree_from_sequences

LANG = ["lang"]
TREE_BUILD = Build(max_depth=4, min_count=20, threshold=3.9075)
PS_BUILD = Build(max_depth=4, min_count=20, estimator=PERES_SHIELDS)
ADJUSTED = Build(max_depth=4, min_count=400, threshold=3.9075, sequencing=Sequencing(True, 1.0, 0.3))
HARDER = 60.0
DEEP = Build(max_depth=9, min_count=2, threshold=3.9075)
GRID = {"max_depth": 5, "min_counts": (20, 200), "thresholds": (3.9075, 10.0)}
FULL_GRID = {"max_depth": 5, "min_counts": M.MIN_COUNTS, "thresholds": M.THRESHOLDS}
DIGITS = 6


def total_variation(build: Build, threshold: Column | None = None) -> tuple[Column, Column]:
    """An estimator of one's own: the child's count times half the summed differences of probabilities."""
    pairs = zip(probabilities(build.pseudo_count), probabilities(build.pseudo_count, "parent_"), strict=True)
    return F.col("count") * sum((F.abs(p - q) for p, q in pairs), F.lit(0.0)) / 2, F.lit(float(build.threshold)) if threshold is None else threshold


#: Rules of one's own: total variation, and five times the least count for contexts of four symbols.
OWN = Build(max_depth=4, min_count=20, threshold=50.0, estimator=total_variation, support=lambda count, depth, least: count >= F.when(depth < 4, least).otherwise(5 * least))


def documents(spark: SparkSession, sf: str, squeeze: bool = True) -> DataFrame:
    """Texts of ``documents`` as sequences, with their language."""
    return from_text(spark.read.parquet(f"{sf}/documents.parquet"), "text", LANG, squeeze)


def lang_kmers(spark: SparkSession, sf: str, k: int, squeeze: bool = True) -> DataFrame:
    return K.count_kmers(documents(spark, sf, squeeze), k, LANG)


def lang_tree(spark: SparkSession, sf: str, build: Build = TREE_BUILD) -> DataFrame:
    return tree_from_sequences(documents(spark, sf), build, LANG)


def lang_tree_written(spark: SparkSession, sf: str) -> DataFrame:
    """The same for queries that read the tree several times."""
    return written(lang_tree(spark, sf), "tree")


def lang_contexts(spark: SparkSession, sf: str, build: Build = TREE_BUILD) -> DataFrame:
    return contexts_from_kmers(lang_kmers(spark, sf, build.k), build, LANG)


def role_kmers(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return K.count_kmers(from_text(spark.read.parquet(f"{sf}/conversations.parquet"), "text", ["role"]), k, ["role"])


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else c for c, t in df.dtypes])


def kmer_counts(spark, sf):
    return lang_kmers(spark, sf, 5)


def kmer_counts_split(spark, sf):
    return lang_kmers(spark, sf, 4, squeeze=False)


def kmer_counts_streamed(spark, sf):
    """The counts of ``kmer_counts``, gathered by a stream over the table's files."""
    path = f"{sf}/documents.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if any(x.endswith("/documents.parquet") for x in table.inputFiles()):  # a stream takes folders: that of the one file, and its name
        stream = stream.option("pathGlobFilter", "documents.parquet").parquet(sf)
    else:
        stream = stream.parquet(path)
    table = shared_dir(spark, "stream")
    count_stream(from_text(stream, "text", LANG), 5, table, f"{table}-checkpoint", LANG).awaitTermination()
    return current_counts(spark, table, LANG)


def _spectrum(spark, sf, k):
    """How many k-mers occur how often."""
    return lang_kmers(spark, sf, k).groupBy("lang", "count").agg(F.count("*").alias("n_kmers"))


def kmer_spectrum_12(spark, sf):
    """Counts of more k-mers than a table of counters holds."""
    return _spectrum(spark, sf, 12)


def kmer_spectrum_28(spark, sf):
    """Counts of k-mers too long for a base-4 number."""
    return _spectrum(spark, sf, 28)


def kmer_union_sum(spark, sf):
    """Counts of documents, then of conversations, united."""
    a = K.count_kmers(documents(spark, sf), 5)
    b = K.count_kmers(from_text(spark.read.parquet(f"{sf}/conversations.parquet"), "text"), 5)
    return K.union_counts(a, b)


def sequence_fragments(spark, sf):
    found = K.fragments(documents(spark, sf, squeeze=False), 4, LANG)
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("fragment").cast("bigint")).alias("symbols"), F.sum(F.length("fragment").cast("bigint") - 3).alias("windows"))


def symbol_functions(spark, sf):
    x = F.col("kmer")
    return lang_kmers(spark, sf, 5).select(
        "lang", "kmer", prefix(x, 3).alias("prefix3"), suffix(x).alias("suffix"), last(x, 2).alias("last2"), replace_first(x, "T").alias("sibling"), symbol_code(x, 1).alias("code1"),
        prefix_index(x, 3).alias("index3"), first_difference(x, F.reverse(x)).alias("differs"), first_difference(x, F.lit("ACGTACGT"), 1, 1).alias("differs_skipped"), F.lit(contexts_up_to(4)).cast("bigint").alias("n_contexts"),
        F.size(all_suffixes(x)).alias("n_suffixes"),
    )


def context_counts(spark, sf):
    return C.roll_up(lang_kmers(spark, sf, 5), 4, LANG)


def context_rollup_check(spark, sf):
    """Each context's count against that of its extensions by one symbol."""
    c = written(C.roll_up(lang_kmers(spark, sf, 4), 3, LANG), "contexts")
    longer = c.filter("depth >= 1").groupBy("lang", prefix(F.col("context"), F.length("context") - 1).alias("context")).agg(F.sum("count").alias("below"))
    return c.join(longer, ["lang", "context"]).select("lang", "context", "count", "below")


def context_support(spark, sf):
    return C.support(C.roll_up(lang_kmers(spark, sf, 5), 4, LANG), TREE_BUILD.min_count)


def context_support_adjusted(spark, sf):
    return C.support(C.roll_up(lang_kmers(spark, sf, 5), 4, LANG), ADJUSTED.min_count, ADJUSTED.sequencing)


def context_closure(spark, sf):
    return contexts_from_kmers(lang_kmers(spark, sf, 5), ADJUSTED, LANG)


def context_orphans(spark, sf):
    supported = written(C.support(C.roll_up(lang_kmers(spark, sf, 5), 4, LANG), ADJUSTED.min_count, ADJUSTED.sequencing), "supported")
    return C.orphans(supported, LANG).select("lang", "context", "depth", "count")


def context_post_order(spark, sf):
    return C.places(lang_contexts(spark, sf), LANG)


def next_symbol_probs(spark, sf):
    return rounded(lang_contexts(spark, sf).select("lang", "context", *[p.alias(f"p_{s}") for s, p in zip(SYMBOLS, probabilities(1.0), strict=True)]))


def edges_kl(spark, sf):
    return rounded(P.edges(lang_contexts(spark, sf), TREE_BUILD, LANG))


def edges_peres_shields(spark, sf):
    return rounded(P.edges(lang_contexts(spark, sf), PS_BUILD, LANG))


def contexts_kept(spark, sf):
    return P.kept(P.edges(lang_contexts(spark, sf), TREE_BUILD, LANG), LANG)


def tree_kl(spark, sf):
    return rounded(lang_tree(spark, sf))


def tree_peres_shields(spark, sf):
    return rounded(lang_tree(spark, sf, PS_BUILD))


def tree_kl_adjusted(spark, sf):
    return rounded(lang_tree(spark, sf, ADJUSTED))


def tree_by_role(spark, sf):
    return rounded(tree_from_kmers(role_kmers(spark, sf, TREE_BUILD.k), TREE_BUILD, ["role"]))


def tree_reprune(spark, sf):
    return rounded(P.reprune(lang_tree_written(spark, sf), HARDER, 1.0, LANG))


def tree_dump(spark, sf):
    """The text form's lines; divergences are shown as they are for inner nodes (-1) and rounded to integers elsewhere."""
    t = lang_tree(spark, sf).withColumn("divergence", F.round("divergence", 0))
    return t.select("lang", dump_line().alias("line"))


def tree_archive(spark, sf):
    """The tree, through archive records and back."""
    return rounded(from_records(to_records(lang_tree(spark, sf), LANG), LANG))


def tree_size(spark, sf):
    return M.size(lang_tree(spark, sf), LANG)


def tree_terminals(spark, sf):
    return M.terminals(lang_tree(spark, sf), LANG)


def tree_remainder(spark, sf):
    return M.remainder(lang_tree_written(spark, sf), LANG)


def _two(spark, sf):
    t = lang_tree_written(spark, sf)
    return [t.filter(F.col("lang") == x).drop("lang") for x in ("de", "en")]


def shared_contexts(spark, sf):
    return M.shared(*_two(spark, sf))


def background_components(spark, sf):
    return rounded(M.components(lang_tree_written(spark, sf), 0, 1.0, LANG))


def background_components_order1(spark, sf):
    return rounded(M.components(lang_tree_written(spark, sf), 1, 1.0, LANG))


def distance(spark, sf):
    return rounded(M.distance(*_two(spark, sf)).select("n_shared", "distance"))


def distance_penalized(spark, sf):
    return rounded(M.distance(*_two(spark, sf)).select("n_shared", "n_missing", "penalized"))


def overlap(both: Column, left_only: Column, right_only: Column) -> dict[str, Column]:
    """A measure of one's own: what share of the contexts, and of their counts, both trees have."""
    weights = F.greatest(F.coalesce("l_count", F.lit(0)), F.coalesce("r_count", F.lit(0)))
    shared = F.sum(F.when(both, F.least("l_count", "r_count")).otherwise(0))
    return {"jaccard": F.try_divide(F.count_if(both).cast("double"), F.count("*").cast("double")), "weighted_jaccard": F.try_divide(shared.cast("double"), F.sum(weights).cast("double"))}


def distance_measures(spark, sf):
    """The angle, the penalised angle and a measure of one's own in one join."""
    return rounded(M.compare(*_two(spark, sf), [M.angle_measure(), M.penalized_measure(), overlap]))


def distance_matrix(spark, sf):
    return rounded(M.distances(lang_tree_written(spark, sf), "lang"))


def distance_order1(spark, sf):
    return rounded(M.distances(lang_tree_written(spark, sf), "lang", background_order=1))


def score_nll(spark, sf):
    """Benchmark texts under each language's tree."""
    items = K.count_kmers(from_text(spark.read.parquet(f"{sf}/benchmark.parquet"), "text"), TREE_BUILD.k)
    tree = lang_tree_written(spark, sf)
    langs = tree.filter("depth = 0").select("lang")
    return rounded(M.score(items.crossJoin(small(langs, "models")), tree, TREE_BUILD.max_depth, 1.0, LANG))


def score_longest_context(spark, sf):
    """The context that scores each distinct k-mer."""
    counts = written(lang_kmers(spark, sf, TREE_BUILD.k), "kmers")
    return M.log_likelihoods(counts, tree_from_kmers(counts, TREE_BUILD, LANG), TREE_BUILD.max_depth, 1.0, LANG).select("lang", "kmer", "count", "context")


def score_documents(spark, sf):
    """Each document under each language's tree."""
    docs = from_text(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id"])
    scores = score_each(docs, lang_tree_written(spark, sf), TREE_BUILD.max_depth, 1.0, LANG, ["doc_id"])
    return rounded(scores.select("doc_id", "lang", "n_windows", "nll"))


def _grid(grid: DataFrame) -> DataFrame:
    keys = [c for c in ("lang",) if c in grid.columns]
    return grid.select(*keys, "max_depth", "min_count", "threshold", "n_params", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("bic_score", 3).alias("bic_score"))


def bic_grid(spark, sf):
    return _grid(bic_sequences(documents(spark, sf), by=LANG, **GRID))


def bic_grid_full(spark, sf):
    """Every point of the fixed grid, at each depth."""
    return _grid(bic_sequences(documents(spark, sf), by=LANG, **FULL_GRID))


def bic_best(spark, sf):
    best = M.bic_best(bic_sequences(documents(spark, sf), by=LANG, **GRID), LANG)
    return best.select("lang", "max_depth", "min_count", "threshold", "n_params")


def tree_depth9(spark, sf):
    """Trees of the default depth and least count."""
    return rounded(lang_tree(spark, sf, DEEP))


def tree_own_rules(spark, sf):
    """Trees by an estimator and a support test of one's own."""
    return rounded(lang_tree(spark, sf, OWN))


def _maintained(spark, sf, build: Build, batches: int = 4) -> DataFrame:
    """Trees that a stream over all documents, dealt to several micro-batches, keeps up to date."""
    path = shared_dir(spark, "maintained")
    documents(spark, sf).repartition(batches).write.parquet(f"{path}/sequences")
    stream = spark.readStream.schema("lang string, seq string").option("maxFilesPerTrigger", 1).parquet(f"{path}/sequences")
    tree = MaintainedTree(spark, f"{path}/tree", build, LANG, whole_every=3)
    tree.start(stream, f"{path}/checkpoint").awaitTermination()
    return rounded(tree.tree())


def tree_maintained(spark, sf):
    return _maintained(spark, sf, TREE_BUILD)


def tree_maintained_peres_shields(spark, sf):
    """What is significant follows the root's count, so it changes with each batch."""
    return _maintained(spark, sf, PS_BUILD)


def _named_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("seq_id"), F.coalesce("lang", F.lit("")).alias("description"), as_symbols(F.coalesce("text", F.lit(""))).alias("seq"))


def fasta_files(spark, sf):
    """All texts, written as FASTA files and read back."""
    path = shared_dir(spark, "fasta")
    write_fasta(_named_sequences(spark, sf), path)
    return read_fasta(spark, path).select("seq_id", "description", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


def fastq_files(spark, sf):
    """All texts, written as FASTQ files and read back."""
    path = shared_dir(spark, "fastq")
    write_fastq(_named_sequences(spark, sf), path)
    return read_fastq(spark, path).select("seq_id", "description", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"), F.length("quality").cast("bigint").alias("n_marks"))


def fasta_kmers(spark, sf):
    """k-mer counts of FASTA files that are read in pieces."""
    path = shared_dir(spark, "fasta")
    write_fasta(_named_sequences(spark, sf), path)
    return K.count_kmers(read_fasta_pieces(spark, path, 5).withColumnRenamed("description", "lang"), 5, LANG)


def kmer_table(spark, sf):
    """k-mer counts, written as a table and read back with its checks."""
    path = shared_dir(spark, "kmer-table")
    lang_kmers(spark, sf, 5).write.parquet(path)
    return read_kmers(spark, path, 5).select("lang", "kmer", "count")


def whole_tree(spark, sf):
    """The one tree of all documents."""
    return tree_from_sequences(documents(spark, sf).select("seq"), TREE_BUILD)


def tree_table(spark, sf):
    """Trees, written as a table and read back."""
    path = shared_dir(spark, "tree-table")
    write_tree(lang_tree(spark, sf), path)
    return rounded(read_tree(spark, path))


def tree_archive_file(spark, sf):
    """The tree of all documents, written as an archive by ranges of its order and read back by ranges of bytes."""
    path = shared_dir(spark, "archive")
    write_archive(whole_tree(spark, sf), path)
    return rounded(read_archive(spark, path, split_bytes=4096).drop("file"))


def tree_dump_file(spark, sf):
    """The text form of the tree of all documents, written and read back, with its numbers of six digits."""
    path = shared_dir(spark, "dump")
    dump(whole_tree(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def grid_csv(spark, sf):
    """The grid of all documents, written as CSV and read back."""
    path = shared_dir(spark, "csv")
    write_grid(bic_sequences(documents(spark, sf).select("seq"), **GRID), path)
    kinds = "n_params bigint, bic_score double, min_count int, max_depth int, threshold double, log_likelihood double, fifth_percentile_frequency int"
    return _grid(spark.read.schema(kinds).option("header", True).csv(path))


def command_line(spark, sf):
    """The tree of all documents as the command line builds, stores, reprunes and reads it."""
    from ..cli import run

    base = shared_dir(spark, "command-line")
    K.count_kmers(documents(spark, sf), TREE_BUILD.k).write.parquet(f"{base}-kmers")
    options = ["--max-depth", str(TREE_BUILD.max_depth), "--min-count", str(TREE_BUILD.min_count), "--threshold", str(TREE_BUILD.threshold)]
    if run(spark, ["--mode", "build-from-kmer-table", "--in-path", f"{base}-kmers", "--out-path", f"{base}-tree", *options]):
        raise RuntimeError("the tree was not built")
    if run(spark, ["--mode", "reprune", "--in-path", f"{base}-tree", "--out-path", f"{base}-harder", "--threshold", str(HARDER)]):
        raise RuntimeError("the tree was not repruned")
    return rounded(read_tree(spark, f"{base}-harder"))


NAMES = (
    kmer_counts, kmer_counts_split, kmer_counts_streamed, kmer_union_sum, sequence_fragments, symbol_functions, context_counts, context_rollup_check, context_support, context_support_adjusted,
    context_closure, context_orphans, context_post_order, next_symbol_probs, edges_kl, edges_peres_shields, contexts_kept, tree_kl, tree_peres_shields, tree_kl_adjusted,
    tree_by_role, tree_reprune, tree_dump, tree_archive, tree_size, tree_terminals, tree_remainder, shared_contexts, background_components, background_components_order1,
    distance, distance_penalized, distance_matrix, distance_order1, score_nll, score_longest_context, bic_grid, bic_best, bic_grid_full,
    kmer_spectrum_12, kmer_spectrum_28, tree_depth9, tree_own_rules, fasta_files, fastq_files, fasta_kmers, kmer_table, tree_table, tree_archive_file, tree_dump_file, grid_csv,
    command_line, tree_maintained, tree_maintained_peres_shields,
    score_documents, distance_measures,
)
QUERIES = {f.__name__: f for f in NAMES}
