"""Queries of corpus preparation and of byte-pair encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import tables, text
from tidewell.operators import bpe, bpe_train, corpus
from tidewell.sources import shards, storage
from tidewell.streaming import corpus_stream

from . import fixtures as fx
from .registry import query

BUDGET = 300_000
FLUSH = 50_000
VAL = 120_000
WINDOW = 256
VOCAB = 32768
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

BYTES = """b AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER)), 0) AS ids FROM documents)"""
STREAM = f"""{BYTES}, placed AS (SELECT ids, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id {_BEFORE}), 0) AS BIGINT) AS before FROM b),
t AS (SELECT before + i - 1 AS o, ids[i] AS token FROM (SELECT before, ids, unnest(range(1, len(ids) + 1)) AS i FROM placed))"""
CHUNKS = f"""s AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id AS pos, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens FROM documents),
r AS (SELECT k, pos, n_tokens, CAST(0 AS BIGINT) AS chunk_id, n_tokens AS held FROM s WHERE k = 1 UNION ALL
  SELECT s.k, s.pos, s.n_tokens, CASE WHEN r.held >= {FLUSH} THEN r.chunk_id + 1 ELSE r.chunk_id END, CASE WHEN r.held >= {FLUSH} THEN s.n_tokens ELSE r.held + s.n_tokens END
  FROM r JOIN s ON s.k = r.k + 1),
chunked AS (SELECT pos, n_tokens, chunk_id, sum(n_tokens) OVER (PARTITION BY chunk_id) >= {FLUSH} AS "full" FROM r),
c AS (SELECT chunk_id, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, bool_and("full") AS f FROM chunked GROUP BY 1),
routed AS (SELECT chunk_id, n_docs, n_tokens, CASE WHEN f AND coalesce(sum(n_tokens) OVER (ORDER BY chunk_id {_BEFORE}), 0) < {VAL} THEN 'val' ELSE 'train' END AS split FROM c)"""


def ids(spark, sf_dir):
    """(pos, ids): the bytes of each text and the end id."""
    return fx.docs(spark, sf_dir).select("pos", corpus.append_end(text.byte_ids(F.col("text"))).alias("ids"))


def _chunked(spark, sf_dir):
    sizes = fx.docs(spark, sf_dir).select("pos", (F.octet_length("text") + 1).cast("long").alias("n_tokens"))
    return corpus.flush_chunks(sizes, FLUSH)


@query("byte_budget_prefix", f"""SELECT * FROM (SELECT doc_id AS pos, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id {_BEFORE}), 0) AS BIGINT) AS bytes_before FROM documents)
  WHERE bytes_before < {BUDGET} OR pos = (SELECT min(doc_id) FROM documents)""")  # fmt: skip
def byte_budget_prefix(spark, sf_dir):
    return corpus.byte_budget_prefix(fx.docs(spark, sf_dir), BUDGET)


WITHIN = f"""SELECT doc_id AS pos, sha256(text) AS text_sha256, n_bytes, bytes_before FROM (SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id {_BEFORE}), 0) AS BIGINT) AS bytes_before FROM documents)
  WHERE bytes_before < {BUDGET} OR doc_id = (SELECT min(doc_id) FROM documents)"""


def _told(rows):
    return rows.select("pos", F.sha2("text", 256).alias("text_sha256"), "n_bytes", "bytes_before")


@query("text_within", WITHIN)
def text_within(spark, sf_dir):
    """The documents of a byte budget by the SQL table function."""
    return _told(tables.text_within(fx.docs(spark, sf_dir), BUDGET))


@query("stream_within", WITHIN)
def stream_within(spark, sf_dir):
    """The documents of a byte budget from the streamed corpus, in several micro-batches."""
    path = scratch(spark)
    corpus_stream.write(fx.docs(spark, sf_dir), f"{path}/corpus", BUDGET // 8)
    stream = corpus_stream.read(spark, f"{path}/corpus", BUDGET, BUDGET // 3, f"{path}/progress")
    corpus_stream.ingest(stream, f"{path}/out", f"{path}/checkpoint")
    return _told(spark.read.schema(corpus_stream.SCHEMA).parquet(f"{path}/out"))


@query("flush_chunks", f'WITH RECURSIVE {CHUNKS} SELECT pos, n_tokens, chunk_id, "full" FROM chunked')
def flush_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir)


@query("shard_split", f"WITH RECURSIVE {CHUNKS} SELECT * FROM routed")
def shard_split(spark, sf_dir):
    return corpus.route_chunks(_chunked(spark, sf_dir), VAL)


@query("shard_meta", f"""WITH RECURSIVE {CHUNKS} SELECT CAST(sum(n_tokens) AS BIGINT) AS total_tokens, CAST(coalesce(sum(n_tokens) FILTER (WHERE split = 'val'), 0) AS BIGINT) AS val_tokens,
  CAST(coalesce(sum(n_tokens) FILTER (WHERE split = 'train'), 0) AS BIGINT) AS train_tokens, CAST({VOCAB} AS BIGINT) AS vocab_size, 'uint16' AS dtype FROM routed""")  # fmt: skip
def shard_meta(spark, sf_dir):
    return corpus.shard_meta(corpus.route_chunks(_chunked(spark, sf_dir), VAL), VOCAB)


@query("append_eot", f"WITH {BYTES} SELECT doc_id AS pos, CAST(len(ids) AS INTEGER) AS n_tokens, ids[-1] AS last_id, sha256(array_to_string(ids, ' ')) AS ids_sha256 FROM b")
def append_eot(spark, sf_dir):
    return ids(spark, sf_dir).select("pos", F.size("ids").alias("n_tokens"), F.element_at("ids", -1).alias("last_id"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


@query("next_token_pairs", f"WITH {STREAM} SELECT a.token AS x, c.token AS y, count(*) AS cnt FROM t a JOIN t c ON c.o = a.o + 1 GROUP BY 1, 2")
def next_token_pairs(spark, sf_dir):
    return corpus.next_pairs(ids(spark, sf_dir)).groupBy("x", "y").agg(F.count("*").alias("cnt"))


_SHA = "sha256(array_to_string({}, ' '))"


@query("token_windows", f"""WITH {STREAM}, x AS (SELECT o // {WINDOW} AS w, list(token ORDER BY o) AS x FROM t GROUP BY 1),
  y AS (SELECT (o - 1) // {WINDOW} AS w, list(token ORDER BY o) AS y FROM t WHERE o > 0 GROUP BY 1)
  SELECT x.w * {WINDOW} AS start, {_SHA.format('x')} AS x_sha256, {_SHA.format('y')} AS y_sha256 FROM x JOIN y USING (w) WHERE len(x) = {WINDOW} AND len(y) = {WINDOW}""")  # fmt: skip
def token_windows(spark, sf_dir):
    told = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " "), 256)
    return corpus.windows(ids(spark, sf_dir), WINDOW).select("start", told("x").alias("x_sha256"), told("y").alias("y_sha256"))


BATCH, LENGTH, SEED = 16, 64, "batch"


RANDOM_BATCH = f"""WITH {STREAM}, n AS (SELECT count(*) AS n FROM t), starts AS (SELECT i, CAST('0x' || substr(md5('{SEED}:' || i), 1, 8) AS BIGINT) % (n - {LENGTH} - 1) AS start FROM (SELECT unnest(range({BATCH})) AS i), n)
  SELECT i, start, array_to_string(list(token ORDER BY o) FILTER (WHERE o < start + {LENGTH}), ' ') AS x, array_to_string(list(token ORDER BY o) FILTER (WHERE o > start), ' ') AS y
  FROM starts JOIN t ON o BETWEEN start AND start + {LENGTH} GROUP BY i, start"""


@query("random_batch", RANDOM_BATCH)
def random_batch(spark, sf_dir):
    n = fx.docs(spark, sf_dir).agg(F.sum(F.octet_length("text") + 1)).first()[0]
    found = corpus.batches(ids(spark, sf_dir), corpus.random_starts(spark, n, LENGTH, BATCH, SEED), LENGTH)
    return found.select("i", "start", F.array_join(F.col("x").cast("array<string>"), " ").alias("x"), F.array_join(F.col("y").cast("array<string>"), " ").alias("y"))


@query("context_crop", f"WITH {BYTES} SELECT doc_id AS pos, {_SHA.format('ids[-64:]')} AS crop_sha256, CAST(least(len(ids), 64) AS INTEGER) AS n FROM b")
def context_crop(spark, sf_dir):
    from tidewell.operators.sampling import crop

    c = ids(spark, sf_dir).select("pos", crop(F.col("ids"), 64).alias("c"))
    return c.select("pos", F.sha2(F.array_join("c", " "), 256).alias("crop_sha256"), F.size("c").alias("n"))


def scratch(spark) -> str:
    """A folder all executors share, for files that a query writes and reads back."""
    return f"{storage.shared_dir(spark)}/tidewell-shard-{uuid.uuid4().hex}"


def _sharded(spark, sf_dir) -> str:
    """The folder where the token stream of all documents is written as shards."""
    path, n = scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = corpus.ordered_stream(fx.docs(spark, sf_dir), F.octet_length("text") + 1, lambda t: corpus.append_end(text.byte_ids(t)), n)
    stream.write.format("token_shard").mode("append").option("path", path).save()
    return path


@query("token_shard_scan", f"WITH {STREAM} SELECT token, count(*) AS cnt, min(o) AS first_offset FROM t GROUP BY 1")
def token_shard_scan(spark, sf_dir):
    """The token stream written as 16-bit shards and scanned again."""
    shards.register(spark)
    path = _sharded(spark, sf_dir)
    read = spark.read.format("token_shard").load(path)
    return read.groupBy("token").agg(F.count("*").alias("cnt"), F.min("offset").alias("first_offset"))


@query("shard_batch", RANDOM_BATCH)
def shard_batch(spark, sf_dir):
    """A batch drawn from shards: their sizes give the number of tokens, and the windows' offsets are pushed into the scan."""
    shards.register(spark)
    path = _sharded(spark, sf_dir)
    starts = corpus.random_starts(spark, shards.total_tokens(path), LENGTH, BATCH, SEED)
    found = shards.windows(spark, path, starts, LENGTH)
    return found.select("i", "start", F.array_join(F.col("x").cast("array<string>"), " ").alias("x"), F.array_join(F.col("y").cast("array<string>"), " ").alias("y"))


# --- byte-pair encoding ---

_W = r"\t-\r \x{85}\p{Z}"
_SENTINEL = rf"regexp_replace(text, '([{_W}])([^{_W}\p{{N}}])', chr(1) || '\1\2', 'g')"
_PIECES = rf"""regexp_extract_all({_SENTINEL}, '\p{{N}}|''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?[^{_W}\p{{L}}\p{{N}}\x01]+|[{_W}]+')"""


@query("pretokenize", f"SELECT doc_id AS pos, CAST(len(p) AS INTEGER) AS n, sha256(array_to_string(p, '|')) AS pieces_sha256 FROM (SELECT doc_id, {_PIECES} AS p FROM documents)")
def pretokenize(spark, sf_dir):
    p = fx.docs(spark, sf_dir).select("pos", bpe.pieces(F.col("text")).alias("p"))
    return p.select("pos", F.size("p").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("pieces_sha256"))


@query("word_counts", f"SELECT piece, count(*) AS cnt FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY 1")
def word_counts(spark, sf_dir):
    return bpe.word_counts(fx.docs(spark, sf_dir))


_PAIRS = """n AS (SELECT ids, unnest(range(1, len(ids) - 1)) AS i FROM b),
pairs AS (SELECT ids[i] AS a, ids[i + 1] AS b, count(*) AS cnt, CAST(min(i) - 1 AS INTEGER) AS first_pos FROM n GROUP BY 1, 2)"""


def _bytes(spark, sf_dir):
    return fx.docs(spark, sf_dir).select(F.col("pos").alias("seq"), text.byte_ids(F.col("text")).alias("ids"))


@query("pair_counts", f"WITH {BYTES}, {_PAIRS} SELECT * FROM pairs")
def pair_counts(spark, sf_dir):
    return bpe.pair_counts_of(_bytes(spark, sf_dir))


@query("best_pair", f"WITH {BYTES}, {_PAIRS} SELECT * FROM pairs ORDER BY cnt DESC, first_pos, a, b LIMIT 1")
def best_pair(spark, sf_dir):
    return bpe.first_of(bpe.pair_counts_of(_bytes(spark, sf_dir)))


@query("bpe_merge_step", f"WITH {BYTES}, m AS (SELECT doc_id, trim(replace(' ' || array_to_string(ids, '  ') || ' ', ' 101  32 ', ' 256 ')) AS s FROM b) SELECT doc_id AS pos, CAST(len(regexp_split_to_array(s, ' +')) AS INTEGER) AS n, sha256(regexp_replace(s, ' +', ' ', 'g')) AS ids_sha256 FROM m")
def bpe_merge_step(spark, sf_dir):
    m = ids(spark, sf_dir).select("pos", bpe.merge(F.col("ids"), 101, 32, 256).alias("m"))
    return m.select("pos", F.size("m").alias("n"), F.sha2(F.array_join(F.col("m").cast("array<string>"), " "), 256).alias("ids_sha256"))


TOY = "the cat sat on the mat"
TOY_MERGES = 4


def _toy_sql() -> str:
    parts = [f"l0 AS (SELECT list_transform(regexp_extract_all(hex(encode('{TOY}')), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS l)"]
    for k in range(TOY_MERGES):
        parts.append(f"m{k} AS (SELECT a, b FROM (SELECT l[i] AS a, l[i + 1] AS b, i FROM (SELECT l, unnest(range(1, len(l))) AS i FROM l{k})) GROUP BY a, b ORDER BY count(*) DESC, min(i) LIMIT 1)")
        parts.append(f"l{k + 1} AS (SELECT CAST(regexp_split_to_array(trim(replace(' ' || array_to_string(l, '  ') || ' ', ' ' || a || '  ' || b || ' ', ' {256 + k} ')), ' +') AS INTEGER[]) AS l FROM l{k}, m{k})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f'SELECT {k} AS rank, a AS "left", b AS "right", {256 + k} AS new_id FROM m{k}' for k in range(TOY_MERGES))


@query("toy_bpe_merges", _toy_sql())
def toy_bpe_merges(spark, sf_dir):
    one = spark.createDataFrame([(TOY,)], "t string").select(text.byte_ids(F.col("t")).alias("ids"))
    return spark.createDataFrame(bpe.train_toy(one, TOY_MERGES), "rank int, left int, right int, new_id int")


@query("bpe_decode", "SELECT doc_id AS seq, sha256(text) AS text_sha256 FROM documents WHERE text <> ''")
def bpe_decode(spark, sf_dir):
    """The bytes of every document, decoded through the vocabulary."""
    found = bpe.decode_arrays(_bytes(spark, sf_dir).filter("size(ids) > 0"), {k: bytes([k]) for k in range(256)})
    return found.select("seq", F.sha2("text", 256).alias("text_sha256"))


@query("special_ids", "SELECT * FROM (VALUES (0, '<|endoftext|>'), (1, '<|pad|>'), (2, '<|im_start|>'), (3, '<|im_end|>')) v(id, token)")
def special_ids(spark, sf_dir):
    return bpe.special_ids(spark)


#: Ids that texts are encoded with, and bytes of text, from the first documents on, that these are learnt from.
TRAINED = 600
TRAINED_BYTES = 2_000_000_000


def _merges(spark, docs, size):
    """Merges of docs up to a size of the vocabulary, however many distinct pieces they have."""
    path = scratch(spark)
    bpe.word_counts(docs).write.parquet(path)
    return bpe_train.train_table(spark.read.parquet(path), size)


def trained(spark, sf_dir):
    """The whole vocabulary, learnt from all documents."""
    return _merges(spark, fx.docs(spark, sf_dir), VOCAB)


def trained_in_budget(spark, sf_dir):
    """A small vocabulary, learnt from the documents of a byte budget."""
    docs = fx.docs(spark, sf_dir)
    last = corpus.byte_budget_prefix(docs, TRAINED_BYTES).agg(F.max("pos").alias("last"))
    return _merges(spark, docs.filter(F.col("pos") <= last.scalar()), TRAINED)


_BASE = len(bpe.SPECIALS)
#: Every step has all distinct pieces with their ids; what a pair has become is written out as in the toy trainer.  Texts
#: after the budget are not learnt from, but their pieces are split by what was learnt, so they stand with a count of 0.
_TRAINED = f"""told AS (SELECT text, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id {_BEFORE}), 0) < {TRAINED_BYTES} OR doc_id = (SELECT min(doc_id) FROM documents) AS within FROM documents),
words AS (SELECT piece, CAST(count(*) FILTER (WHERE within) AS BIGINT) AS cnt FROM (SELECT unnest({_PIECES}) AS piece, within FROM told) GROUP BY 1),
r AS (SELECT 0 AS step, piece, cnt, list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda h: CAST('0x' || h AS INTEGER) + {_BASE}) AS l, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b FROM words
  UNION ALL (WITH cur AS (SELECT * FROM r WHERE step < {TRAINED - 256 - _BASE}),
    best AS (SELECT a, b FROM (SELECT l[i] AS a, l[i + 1] AS b, sum(cnt) AS n FROM (SELECT l, cnt, unnest(range(1, len(l))) AS i FROM cur) GROUP BY 1, 2) WHERE n >= 2 ORDER BY n DESC, a, b LIMIT 1)
    SELECT step + 1, piece, cnt, CAST(regexp_split_to_array(trim(replace(' ' || array_to_string(l, '  ') || ' ', ' ' || best.a || '  ' || best.b || ' ', ' ' || {256 + _BASE} + step || ' ')), ' +') AS INTEGER[]), best.a, best.b FROM cur, best))"""


#: A step merges the best pairs up to the first that shares an id with one before it, as the left id of one and the right
#: id of the other: until then no merge changes the count of a later one, and no new pair comes before it, so the result is
#: that of one merge after another.  Pieces have keys from 1 on, merges have keys -1, -2, ... in their order.
_LEARNT = f"""words AS (SELECT piece, count(*) AS cnt FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY 1),
t(k, cnt, l) USING KEY (k) AS (SELECT row_number() OVER () AS k, cnt, list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda h: CAST('0x' || h AS INTEGER) + {_BASE}) AS l FROM words
  UNION (WITH done AS (SELECT count(*) AS n FROM recurring.t WHERE k < 0),
    e AS MATERIALIZED (SELECT k, cnt, i, l[i] AS a, l[i + 1] AS b FROM (SELECT k, cnt, l, unnest(range(1, len(l))) AS i FROM recurring.t WHERE k > 0)),
    p AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY sum(cnt) DESC, a, b) AS o FROM e GROUP BY a, b HAVING sum(cnt) >= 2),
    clash AS (SELECT greatest(2, min(greatest(x.o, y.o))) AS o FROM (SELECT a AS id, min(o) AS o FROM p GROUP BY 1) x JOIN (SELECT b AS id, min(o) AS o FROM p GROUP BY 1) y USING (id)),
    m AS MATERIALIZED (SELECT a, b, done.n + p.o AS new FROM p, done, clash WHERE p.o < coalesce(clash.o, p.o + 1) AND done.n + p.o <= {VOCAB - 256 - _BASE}),
    hit AS MATERIALIZED (SELECT k, i, new, i - row_number() OVER (PARTITION BY k ORDER BY i) AS run FROM e JOIN m USING (a, b)),
    taken AS MATERIALIZED (SELECT k, i, new FROM (SELECT k, i, new, row_number() OVER (PARTITION BY k, run ORDER BY i) AS o FROM hit) WHERE o % 2 = 1),
    old AS (SELECT k, cnt, i, l[i] AS id FROM (SELECT k, cnt, l, unnest(range(1, len(l) + 1)) AS i FROM recurring.t WHERE k IN (SELECT k FROM taken)))
    SELECT old.k, any_value(cnt), list(coalesce(here.new + {255 + _BASE}, id) ORDER BY old.i) FROM old LEFT JOIN taken here ON here.k = old.k AND here.i = old.i
      LEFT JOIN taken gone ON gone.k = old.k AND gone.i = old.i - 1 WHERE gone.k IS NULL GROUP BY old.k
    UNION ALL SELECT -new, 0, [a, b] FROM m))"""


@query("bpe_train", f'WITH RECURSIVE {_LEARNT} SELECT CAST(-1 - k AS INTEGER) AS rank, l[1] AS "left", l[2] AS "right", CAST({255 + _BASE} - k AS INTEGER) AS new_id FROM t WHERE k < 0')
def trained_merges(spark, sf_dir):
    return spark.createDataFrame(trained(spark, sf_dir), "rank int, left int, right int, new_id int")


@query("bpe_encode", f"""WITH RECURSIVE {_TRAINED}, done AS (SELECT piece, l FROM r WHERE step = (SELECT max(step) FROM r)),
  cut AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_PIECES} AS p FROM documents)),
  whole AS (SELECT doc_id, flatten(list(l ORDER BY i)) AS ids FROM (SELECT doc_id, i, l FROM cut JOIN done ON piece = p[i]) GROUP BY doc_id)
  SELECT d.doc_id AS pos, CAST(coalesce(len(ids), 0) AS INTEGER) AS n, sha256(coalesce(array_to_string(ids, ' '), '')) AS ids_sha256 FROM documents d LEFT JOIN whole USING (doc_id)""")  # fmt: skip
def bpe_encode(spark, sf_dir):
    return bpe.encode(fx.docs(spark, sf_dir), trained_in_budget(spark, sf_dir)).select("pos", F.size("ids").alias("n"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


@query("encode_special_tokens", f"""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(hex(encode(role || chr(10) || text)), '..'), lambda h: CAST('0x' || h AS INTEGER) + {_BASE}) AS b FROM conversations),
  l AS (SELECT conv_id, turn, list_concat([{bpe.SPECIALS.index("<|im_start|>")}], list_concat(b, [{bpe.SPECIALS.index("<|im_end|>")}, 10 + {_BASE}])) AS l FROM t)
  SELECT conv_id AS pos, CAST(sum(len(l)) AS INTEGER) AS n, sha256(string_agg(array_to_string(l, ' '), ' ' ORDER BY turn)) AS ids_sha256 FROM l GROUP BY 1""")  # fmt: skip
def encode_special_tokens(spark, sf_dir):
    """Conversations written out in the chat template and encoded, before any merge: the marks are one id each."""
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    prompts = fx.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("pos")).agg(F.array_join(F.transform(turns, lambda s: s["line"]), "").alias("text"))
    return bpe.encode(prompts, []).select("pos", F.size("ids").alias("n"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


@query("tokenizer_roundtrip", "SELECT count(*) AS n, true AS same FROM documents")
def tokenizer_roundtrip(spark, sf_dir):
    """Whether decoding what was encoded gives every text back."""
    merges = trained_in_budget(spark, sf_dir)
    docs, base = fx.docs(spark, sf_dir), len(bpe.SPECIALS)
    vocab = {base + k: bytes([k]) for k in range(256)}
    for _, a, b, new in merges:
        vocab[new] = vocab[a] + vocab[b]
    back = bpe.there_and_back(docs, merges, vocab)
    return back.agg(F.count("*").alias("n"), F.bool_and(F.coalesce("again", F.lit("")) == F.col("text")).alias("same"))
