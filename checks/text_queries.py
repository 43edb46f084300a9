"""Queries of the caption side: splits, captions, vocabulary, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import fixtures as fx
from checks.fixtures import with_views
from checks.registry import query
from framelark.functions.storage import write_through
from framelark.functions.text import strip_ptb_punct, tokenize_eval, tokenize_vocab
from framelark.operators import caption_metrics as m, captions, features, splits
from framelark.plans import evaluation

KEY = "video_id"
CANON = {
    "canon": """SELECT * REPLACE (CASE WHEN split='validate' THEN 'val' ELSE split END AS split)
                FROM fx_videos WHERE split IN ('train','validate','val','test')""",
    "sp": "SELECT unnest(['train','val','test']) AS split",
}
NUM = "CAST(replace(video_id,'video','') AS BIGINT)"
TOKV = r"list_filter(string_split_regex(regexp_replace(lower(caption),'[^a-z0-9\s]','','g'),'\s+'), lambda w: w<>'')"
TEXTE = r"trim(regexp_replace(regexp_replace(lower(caption),'[^a-z0-9\s]',' ','g'),'\s+',' ','g'))"
TOKE = rf"list_filter(string_split({TEXTE},' '), lambda w: w<>'')"


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def joined(col) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


# --- splits ---------------------------------------------------------------


@query("M1_canonical_splits", with_views(["fx_videos"], CANON, "SELECT video_id, split, category FROM canon"))
def _(s, sf):
    return splits.canonical_splits(fx.videos(s, sf)).select(KEY, "split", "category")


@query("M2_split_positions", with_views(["fx_videos"], CANON, f"""SELECT split, video_id, {NUM} AS number,
    row_number() OVER (PARTITION BY split ORDER BY {NUM})-1 AS position FROM canon"""))  # fmt: skip
def _(s, sf):
    return splits.split_positions(fx.videos(s, sf))


@query("M3_filter_requested", with_views(["fx_videos", "fx_sentences"], {
    "req": """SELECT DISTINCT CASE WHEN cap_id=0 THEN video_id END AS video_id, CAST(replace(video_id,'video','') AS BIGINT) AS id FROM fx_sentences"""},
    "SELECT video_id, split FROM fx_videos WHERE video_id IN (SELECT coalesce(video_id, concat('video',id)) FROM req)"))
def _(s, sf):
    sent = fx.sentences(s, sf)
    requested = sent.select(
        F.when(F.col("cap_id") == 0, F.col(KEY)).alias(KEY),
        F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint").alias("id"),
    )
    return splits.filter_requested(fx.videos(s, sf), requested).select(KEY, "split")


BEST_FILE = {"bf": "SELECT video_id, min(struct_pack(r:=root_priority, p:=path)).p AS path FROM fx_files GROUP BY 1"}


@query("M4_resolve_splits", with_views(["fx_videos", "fx_files"], {**CANON, **BEST_FILE}, f"""SELECT split, video_id, path,
    row_number() OVER (PARTITION BY split ORDER BY {NUM})-1 AS position FROM canon LEFT JOIN bf USING (video_id)"""))  # fmt: skip
def _(s, sf):
    return splits.resolve_splits(fx.videos(s, sf), features.index_files(fx.files(s, sf).drop("family", "dim")))


@query("M4_resolution_report", with_views(["fx_videos", "fx_files"], {**CANON, **BEST_FILE}, """SELECT split, count(path) AS present,
    count(*)-count(path) AS absent FROM canon LEFT JOIN bf USING (video_id) GROUP BY 1"""))  # fmt: skip
def _(s, sf):
    files = features.index_files(fx.files(s, sf).drop("family", "dim"))
    return splits.resolution_report(splits.resolve_splits(fx.videos(s, sf), files))


@query("M5_split_counts", with_views(["fx_videos"], CANON, "SELECT split, count(video_id) AS n FROM sp LEFT JOIN canon USING (split) GROUP BY 1"))
def _(s, sf):
    return splits.split_counts(fx.videos(s, sf))


@query("M6_category_map", with_views(["fx_videos"], {}, "SELECT video_id, arg_max(category, id) AS category FROM fx_videos WHERE split='test' GROUP BY 1"))
def _(s, sf):
    return splits.category_map(fx.videos(s, sf))


@query("M7_train_length_by_category", with_views(["fx_videos"], {}, """SELECT category, count(*) AS num_train_videos,
    round(avg(end_time-start_time),6) AS avg_train_duration_sec FROM fx_videos WHERE split='train' GROUP BY 1"""))  # fmt: skip
def _(s, sf):
    return splits.train_length_by_category(fx.videos(s, sf)).select("category", "num_train_videos", *r6("avg_train_duration_sec"))


@query("M8_limit_per_split", with_views(["fx_videos"], CANON, f"""SELECT split, video_id, CAST(position AS INT) AS position FROM (SELECT split, video_id,
    row_number() OVER (PARTITION BY split ORDER BY {NUM}) AS position FROM canon) WHERE position<=25"""))  # fmt: skip
def _(s, sf):
    return splits.limit_per_split(fx.videos(s, sf), 25)


@query("M9_range_coverage", with_views(["fx_files"], {}, """SELECT concat('video',i) AS video_id FROM (SELECT unnest(range(0,10000)) AS i)
    WHERE concat('video',i) NOT IN (SELECT replace(CASE WHEN root_priority=2 THEN concat(video_id,' 2') ELSE video_id END,' 2','') FROM fx_files WHERE family='clip')"""))  # fmt: skip
def _(s, sf):
    clip = fx.files(s, sf).filter("family = 'clip'")
    copied = clip.withColumn(KEY, F.when(F.col("root_priority") == 2, F.concat(KEY, F.lit(" 2"))).otherwise(F.col(KEY)))
    return splits.range_coverage(copied, 0, 9999)


# --- captions -------------------------------------------------------------


@query("C1_number_captions", with_views(["fx_sentences"], {}, """SELECT concat('lang_', lang) AS video_id, doc_id,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1 AS cap_id, length(text) AS size FROM documents"""))  # fmt: skip
def _(s, sf):
    docs = fx.table(s, sf, "documents").select(F.concat(F.lit("lang_"), "lang").alias(KEY), "doc_id", "text")
    return captions.number_captions(docs, "doc_id").select(KEY, "doc_id", "cap_id", F.length("text").cast("bigint").alias("size"))


@query("C2_captions_by_split", with_views(["fx_videos", "fx_sentences"], CANON, "SELECT video_id, cap_id, split, caption FROM fx_sentences JOIN canon USING (video_id)"))
def _(s, sf):
    return captions.captions_by_split(fx.videos(s, sf), fx.sentences(s, sf))


@query("C2_missing_captions", with_views(["fx_videos", "fx_sentences"], CANON, "SELECT split, video_id FROM canon WHERE video_id NOT IN (SELECT video_id FROM fx_sentences)"))
def _(s, sf):
    return captions.missing_captions(fx.videos(s, sf), fx.sentences(s, sf))


@query("C3_caption_report", with_views(["fx_videos", "fx_sentences"], {**CANON, "c": "SELECT video_id, count(*) AS caps FROM fx_sentences GROUP BY 1"},
    """SELECT split, count(video_id) AS expected, count(caps) AS with_captions, count(video_id)-count(caps) AS missing,
       CAST(coalesce(sum(caps),0) AS BIGINT) AS captions FROM sp LEFT JOIN (SELECT * FROM canon LEFT JOIN c USING (video_id)) USING (split) GROUP BY 1"""))  # fmt: skip
def _(s, sf):
    return captions.caption_report(fx.videos(s, sf), fx.sentences(s, sf))


@query("C4_tokenize_vocab", with_views(["fx_sentences"], {}, f"SELECT video_id, cap_id, array_to_string({TOKV},' ') AS text FROM fx_sentences"))
def _(s, sf):
    return fx.sentences(s, sf).select(KEY, "cap_id", F.array_join(tokenize_vocab(F.col("caption")), " ").alias("text"))


@query("C5_tokenize_eval", with_views(["fx_sentences"], {}, f"SELECT video_id, cap_id, {TEXTE} AS text FROM fx_sentences"))
def _(s, sf):
    return fx.sentences(s, sf).select(KEY, "cap_id", tokenize_eval(F.col("caption")).alias("text"))


@query("C6_strip_ptb_punct", with_views(["fx_sentences"], {}, r"""SELECT video_id, cap_id, array_to_string(list_filter(string_split(
    trim(replace(regexp_replace(caption,'([.,?!;:])',' \1 ','g'), chr(10), ' ')),' '), lambda w: w<>'' AND w NOT IN
    ('''''','''','``','`','-LRB-','-RRB-','-LCB-','-RCB-','.','?','!',',',':','-','--','...',';')),' ') AS text FROM fx_sentences"""))  # fmt: skip
def _(s, sf):
    spaced = F.regexp_replace("caption", r"([.,?!;:])", " $1 ")
    return fx.sentences(s, sf).select(KEY, "cap_id", strip_ptb_punct(spaced).alias("text"))


@query("C7_tokenization_report", with_views(["fx_sentences", "fx_turns"], {
    "a": "SELECT video_id, count(*) AS n_original FROM fx_sentences GROUP BY 1",
    "b": f"SELECT video_id, count(*) AS n_tokenized, bool_or({TEXTE}<>'') AS t FROM fx_turns GROUP BY 1"},
    "SELECT video_id, n_original, n_tokenized, coalesce(n_original=n_tokenized AND t, false) AS valid FROM a FULL JOIN b USING (video_id)"))
def _(s, sf):
    tokenized = fx.turns(s, sf).withColumn("caption", tokenize_eval(F.col("caption")))
    return captions.tokenization_report(fx.sentences(s, sf), tokenized)


WORDS = {
    "tk": f"SELECT video_id, cap_id, {TOKV} AS t FROM fx_sentences",
    "w": "SELECT video_id, cap_id, i-1 AS pos, t[i] AS word FROM (SELECT *, unnest(range(1,len(t)+1)) AS i FROM tk)",
}
VOCAB = {
    **WORDS,
    "fr": f"SELECT word, count(*) AS freq, min(struct_pack(n:={NUM}, c:=cap_id, p:=pos)) AS seen FROM w GROUP BY 1 HAVING count(*)>=2",
    "voc": """SELECT word, CAST(row_number() OVER (ORDER BY seen)+3 AS INT) AS idx, freq FROM fr UNION ALL
              SELECT * FROM (VALUES ('<pad>',0,NULL),('<sos>',1,NULL),('<eos>',2,NULL),('<unk>',3,NULL)) v(word,idx,freq)""",
    "enc": """SELECT tk.video_id, tk.cap_id, list_concat(list_concat([1], coalesce(b,[])), [2]) AS ids FROM tk LEFT JOIN
              (SELECT video_id, cap_id, list(coalesce(idx,3) ORDER BY pos) AS b FROM w LEFT JOIN voc USING (word) GROUP BY 1,2) e
              ON tk.video_id=e.video_id AND tk.cap_id=e.cap_id""",
}


@query("C8_word_counts", with_views(["fx_sentences"], WORDS, "SELECT word, count(*) AS freq FROM w GROUP BY 1"))
def _(s, sf):
    return captions.word_counts(fx.sentences(s, sf))


@query("C9_build_vocab", with_views(["fx_sentences"], VOCAB, "SELECT * FROM voc"))
def _(s, sf):
    return captions.build_vocab(fx.sentences(s, sf))


def encoded(s, sf) -> DataFrame:
    sent = fx.sentences(s, sf)
    return captions.encode_captions(sent, captions.build_vocab(sent))


@query("C10_encode_captions", with_views(["fx_sentences"], VOCAB, "SELECT video_id, cap_id, array_to_string(ids,' ') AS ids FROM enc"))
def _(s, sf):
    return encoded(s, sf).select(KEY, "cap_id", joined("ids").alias("ids"))


@query("C11_decode_ids", with_views(["fx_sentences"], {**VOCAB, "dw": """SELECT video_id, cap_id, pos, CASE WHEN idx IS NULL THEN '<unk>' ELSE word END AS word
    FROM w LEFT JOIN voc USING (word)"""},
    """SELECT tk.video_id, tk.cap_id, coalesce(text,'') AS text FROM tk LEFT JOIN (SELECT video_id, cap_id, string_agg(word,' ' ORDER BY pos) AS text
       FROM dw GROUP BY 1,2) d ON tk.video_id=d.video_id AND tk.cap_id=d.cap_id"""))  # fmt: skip
def _(s, sf):
    sent = fx.sentences(s, sf)
    vocab = write_through(captions.build_vocab(sent), "vocab")
    return captions.decode_ids(captions.encode_captions(sent, vocab), vocab)


@query("C12_pad_batch", with_views(["fx_sentences"], {**VOCAB, "mx": "SELECT *, max(len(ids)) OVER (PARTITION BY video_id) AS m FROM enc"},
    "SELECT video_id, cap_id, array_to_string(list_concat(ids, list_transform(range(0,m-len(ids)), lambda x: 0)),' ') AS ids FROM mx"))
def _(s, sf):
    return captions.pad_batch(encoded(s, sf), batch=KEY).select(KEY, "cap_id", joined("ids").alias("ids"))


@query("C13_mask_labels", with_views(["fx_sentences"], {**VOCAB, "mx": "SELECT *, max(len(ids)) OVER (PARTITION BY video_id) AS m FROM enc",
    "pd": "SELECT video_id, cap_id, list_concat(ids, list_transform(range(0,m-len(ids)), lambda x: 0))[1:64] AS ids FROM mx"},
    """SELECT video_id, cap_id, array_to_string(ids,' ') AS ids,
       array_to_string(list_transform(ids, lambda x: CASE WHEN x=0 THEN -100 ELSE x END),' ') AS labels FROM pd"""))  # fmt: skip
def _(s, sf):
    out = captions.mask_labels(captions.pad_batch(encoded(s, sf), batch=KEY), 64)
    return out.select(KEY, "cap_id", joined("ids").alias("ids"), joined("labels").alias("labels"))


@query("C14_assign_batches", with_views(["fx_videos"], {}, """SELECT video_id, CAST((row_number() OVER (ORDER BY md5(concat('7:',video_id)), video_id)-1)//64 AS BIGINT) AS batch
    FROM fx_videos"""))  # fmt: skip
def _(s, sf):
    return captions.assign_batches(fx.videos(s, sf).select(KEY), 7, 64)


@query("C15_sample_caption", with_views(["fx_sentences"], {}, """SELECT video_id, cap_id, caption FROM (SELECT *, row_number() OVER (PARTITION BY video_id
    ORDER BY md5(concat('3:',video_id,':',cap_id))) AS k FROM fx_sentences) WHERE k=1"""))  # fmt: skip
def _(s, sf):
    return captions.sample_caption(fx.sentences(s, sf), 3)


@query("C16_preview_samples", with_views(["fx_pred", "fx_refs"], {
    "ch": "SELECT video_id, caption AS prediction FROM fx_pred ORDER BY md5(concat('5:',video_id)), video_id LIMIT 20",
    "rf": "SELECT video_id, caption AS reference, CAST(row_number() OVER (PARTITION BY video_id ORDER BY cap_id) AS INT) AS ref_no FROM fx_refs"},
    "SELECT video_id, prediction, ref_no, reference FROM ch JOIN rf USING (video_id) WHERE ref_no<=3"))
def _(s, sf):
    return captions.preview_samples(fx.predictions(s, sf), fx.references(s, sf), 20, 5)


# --- metrics --------------------------------------------------------------


def pairs(s, sf):
    return m.scored_pairs(fx.predictions(s, sf), fx.references(s, sf))


TOK = {
    "hp": f"SELECT video_id, category, {TOKE} AS t FROM fx_pred WHERE video_id IN (SELECT video_id FROM fx_refs)",
    "rf": f"SELECT video_id, category, cap_id, {TOKE} AS t FROM fx_refs WHERE video_id IN (SELECT video_id FROM fx_pred)",
}


def grams(src: str, ids: str) -> str:
    return f"""SELECT {ids}, n, gram, count(*) AS cnt FROM (SELECT {ids}, n, array_to_string(t[i:i+n-1],' ') AS gram
               FROM (SELECT *, unnest(range(1,len(t)-n+2)) AS i FROM (SELECT *, unnest([1,2,3,4]) AS n FROM {src}))) GROUP BY ALL"""


GRAMS = {**TOK, "hg": grams("hp", "video_id, category"), "rg": grams("rf", "video_id, category, cap_id")}
LEN = {
    "ln": """SELECT hp.video_id, hp.category, len(hp.t) AS test_len, CAST(min(struct_pack(d:=abs(len(rf.t)-len(hp.t)), l:=len(rf.t))).l AS DOUBLE) AS ref_len,
             CAST(min(len(rf.t)) AS DOUBLE) AS shortest, avg(len(rf.t)) AS average FROM hp JOIN rf USING (video_id) GROUP BY ALL"""
}
COMP = {
    **GRAMS,
    **LEN,
    "mx": "SELECT video_id, n, gram, max(cnt) AS most FROM rg GROUP BY ALL",
    "hit": "SELECT video_id, n, CAST(sum(least(cnt,most)) AS BIGINT) AS c FROM hg JOIN mx USING (video_id,n,gram) GROUP BY ALL",
    "bc": "SELECT ln.video_id, ln.category, test_len, ref_len, "
    + ", ".join(f"greatest(0,test_len-{k - 1}) AS guess_{k}" for k in range(1, 5))
    + ", "
    + ", ".join(f"coalesce(max(c) FILTER (n={k}),0) AS correct_{k}" for k in range(1, 5))
    + " FROM ln LEFT JOIN hit USING (video_id) GROUP BY ALL",
}


def bleu_sql(group: str, src: str) -> str:
    ratio = "((test_len+1e-15)/(ref_len+1e-9))"
    out, prod = [], "1e0"
    for k in range(1, 5):
        prod += f"*((correct_{k}+1e-15)/(guess_{k}+1e-9))"
        out.append(f"round(pow({prod},1e0/{k})*CASE WHEN {ratio}<1 THEN exp(1-1/{ratio}) ELSE 1e0 END,6) AS bleu_{k}")
    return f"SELECT {group}{', '.join(out)} FROM {src}"


SUMS = ", ".join(
    f"CAST(sum({c}) AS DOUBLE) AS {c}"
    for c in ["test_len", "ref_len", *[f"{w}_{k}" for w in ("guess", "correct") for k in range(1, 5)]]
)
BLEU = [f"bleu_{k}" for k in range(1, 5)]


def cider_ctes(by: str = "") -> dict[str, str]:
    """CIDEr steps; ``by`` is empty or a column of both tables."""
    b, on = (f"{by}, ", f"USING ({by}, n, gram)") if by else ("", "USING (n, gram)")
    size = f"SELECT {b}count(*) AS big FROM hp" + (f" GROUP BY {by}" if by else "")
    join = f"JOIN sz USING ({by})" if by else ", sz"
    weight = "cnt*(ln(CAST(big AS DOUBLE))-ln(greatest(1e0,CAST(coalesce(df,1) AS DOUBLE)))) AS w"
    return {
        **GRAMS,
        "dfq": f"SELECT {b}n, gram, count(DISTINCT video_id) AS df FROM rg GROUP BY ALL",
        "sz": size,
        "hw": f"SELECT *, {weight} FROM (SELECT * FROM hg LEFT JOIN dfq {on}) {join}",
        "rw": f"SELECT *, {weight} FROM (SELECT * FROM rg LEFT JOIN dfq {on}) {join}",
        "hn": "SELECT video_id, n, sqrt(sum(w*w)) AS nh FROM hw GROUP BY ALL",
        "rn": "SELECT video_id, cap_id, n, sqrt(sum(w*w)) AS nr FROM rw GROUP BY ALL",
        "vv": """SELECT rw.video_id, rw.cap_id, rw.n, sum(least(hw.w,rw.w)*rw.w) AS v FROM rw JOIN hw
                 ON rw.video_id=hw.video_id AND rw.n=hw.n AND rw.gram=hw.gram GROUP BY ALL""",
        "sm": """SELECT rf.video_id, rf.cap_id, greatest(0,len(hp.t)-1) AS lh, greatest(0,len(rf.t)-1) AS lr,
                 coalesce(sum(CASE WHEN nh<>0 AND nr<>0 THEN v/(nh*nr) ELSE v END),0e0) AS s
                 FROM rf JOIN hp ON rf.video_id=hp.video_id LEFT JOIN vv ON vv.video_id=rf.video_id AND vv.cap_id=rf.cap_id
                 LEFT JOIN hn ON hn.video_id=rf.video_id AND hn.n=vv.n LEFT JOIN rn ON rn.video_id=rf.video_id AND rn.cap_id=rf.cap_id AND rn.n=vv.n
                 GROUP BY ALL""",
        "cd": "SELECT video_id, 10e0*avg(s/4e0*exp(-((lh-lr)*(lh-lr))/72e0)) AS cider FROM sm GROUP BY 1",
    }


ALIGN = {
    **TOK,
    "ho": "SELECT *, row_number() OVER (PARTITION BY video_id, tok ORDER BY h) AS occ FROM (SELECT video_id, t[i] AS tok, i AS h FROM (SELECT *, unnest(range(1,len(t)+1)) AS i FROM hp))",
    "ro": "SELECT *, row_number() OVER (PARTITION BY video_id, cap_id, tok ORDER BY r) AS occ FROM (SELECT video_id, cap_id, t[i] AS tok, i AS r FROM (SELECT *, unnest(range(1,len(t)+1)) AS i FROM rf))",
    "mt": "SELECT video_id, cap_id, h, r, lag(h) OVER w AS ph, lag(r) OVER w AS pr FROM ho JOIN ro USING (video_id, tok, occ) WINDOW w AS (PARTITION BY video_id, cap_id ORDER BY h)",
    "mc": "SELECT video_id, cap_id, count(*) AS matches, CAST(sum(CASE WHEN h=ph+1 AND r=pr+1 THEN 0 ELSE 1 END) AS BIGINT) AS chunks FROM mt GROUP BY ALL",
    "ma": """SELECT rf.video_id, rf.cap_id, len(hp.t) AS hyp_len, len(rf.t) AS ref_len, coalesce(matches,0) AS matches, coalesce(chunks,0) AS chunks
             FROM rf JOIN hp ON rf.video_id=hp.video_id LEFT JOIN mc ON mc.video_id=rf.video_id AND mc.cap_id=rf.cap_id""",
    "ms": """SELECT video_id, CASE WHEN matches=0 THEN 0e0 ELSE (1e0-0.5e0*pow(chunks/matches,3))*
             (10e0*(matches/greatest(hyp_len,1))*(matches/greatest(ref_len,1)))/greatest(matches/greatest(ref_len,1)+9e0*matches/greatest(hyp_len,1),1e-8) END AS sc FROM ma""",
    "mv": "SELECT video_id, max(sc) AS meteor FROM ms GROUP BY 1",
}
# Rows of the table are the reference positions; each step adds one prediction token.
LCS = {
    **TOK,
    "rt": "SELECT rf.video_id, rf.cap_id, i AS j, rf.t[i] AS tok, hp.t AS ht FROM (SELECT *, unnest(range(1,len(t)+1)) AS i FROM rf) rf JOIN hp ON rf.video_id=hp.video_id",
    "dp": """SELECT video_id, cap_id, j, tok, ht, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS v FROM rt
             UNION ALL SELECT video_id, cap_id, j, tok, ht, i+1, max(c) OVER (PARTITION BY video_id, cap_id ORDER BY j) FROM (
               SELECT *, greatest(v, CASE WHEN ht[i+1]=tok THEN coalesce(lag(v) OVER (PARTITION BY video_id, cap_id ORDER BY j),0)+1 ELSE 0 END) AS c
               FROM dp WHERE i<len(ht))""",
    "lc": """SELECT rf.video_id, rf.cap_id, len(hp.t) AS hyp_len, len(rf.t) AS ref_len, CAST(coalesce(max(v),0) AS INT) AS lcs FROM rf JOIN hp ON rf.video_id=hp.video_id
             LEFT JOIN dp ON dp.video_id=rf.video_id AND dp.cap_id=rf.cap_id GROUP BY ALL""",
    "rv": """SELECT video_id, max(CASE WHEN lcs=0 THEN 0e0 ELSE 2e0*(lcs/hyp_len)*(lcs/ref_len)/((lcs/hyp_len)+(lcs/ref_len)) END) AS rouge_l FROM lc GROUP BY 1""",
}
V = ["fx_pred", "fx_refs"]


@query("F1_ngram_counts", with_views(V, GRAMS, "SELECT video_id, cap_id, CAST(n AS INT) AS n, gram, cnt FROM rg"))
def _(s, sf):
    return m.ngram_counts(pairs(s, sf)[1], [KEY, "cap_id"])


@query("F2_bleu_components", with_views(V, COMP, "SELECT * EXCLUDE (category) FROM bc"))
def _(s, sf):
    return m.bleu_components(*pairs(s, sf))


@query("F3_ref_length", with_views(V, {**TOK, **LEN}, "SELECT video_id, test_len, ref_len AS closest, shortest, round(average,6) AS average FROM ln"))
def _(s, sf):
    p, r = pairs(s, sf)
    close = m.ref_length(p, r).withColumnRenamed("ref_len", "closest")
    short = m.ref_length(p, r, "shortest").select(KEY, F.col("ref_len").alias("shortest"))
    mean = m.ref_length(p, r, "average").select(KEY, F.round("ref_len", 6).alias("average"))
    return close.join(short, KEY).join(mean, KEY)


@query("F4_bleu_per_video", with_views(V, COMP, bleu_sql("video_id, ", "bc")))
def _(s, sf):
    return m.bleu_per_video(*pairs(s, sf)).select(KEY, *r6(*BLEU))


@query("F5_bleu_corpus", with_views(V, COMP, bleu_sql("", f"(SELECT {SUMS} FROM bc)")))
def _(s, sf):
    return m.bleu_corpus(*pairs(s, sf)).select(*r6(*BLEU))


@query("F6_document_frequency", with_views(V, GRAMS, "SELECT CAST(n AS INT) AS n, gram, count(DISTINCT video_id) AS df FROM rg GROUP BY ALL"))
def _(s, sf):
    return m.document_frequency(pairs(s, sf)[1])


@query("F7_cider_vectors", with_views(V, cider_ctes(), """SELECT video_id, cap_id, CAST(n AS INT) AS n, round(sqrt(sum(w*w)),6) AS norm,
    CAST(sum(CASE WHEN n=2 THEN cnt ELSE 0 END) AS BIGINT) AS bigrams FROM rw GROUP BY ALL"""))  # fmt: skip
def _(s, sf):
    return m.cider_vectors(*pairs(s, sf)).select(KEY, "cap_id", "n", *r6("norm"), "bigrams")


@query("F8_cider_per_video", with_views(V, cider_ctes(), "SELECT video_id, round(cider,6) AS cider FROM cd"))
def _(s, sf):
    return m.cider_per_video(*pairs(s, sf)).select(KEY, *r6("cider"))


@query("F9_cider_corpus", with_views(V, cider_ctes(), "SELECT round(avg(cider),6) AS cider FROM cd"))
def _(s, sf):
    return m.cider_corpus(*pairs(s, sf)).select(*r6("cider"))


@query("F9_cider_by_category", with_views(V, cider_ctes("category"), "SELECT category, round(avg(cider),6) AS cider FROM cd JOIN hp USING (video_id) GROUP BY 1"))
def _(s, sf):
    return m.cider_corpus(*pairs(s, sf), ["category"]).select("category", *r6("cider"))


@query("F10_lcs_length", with_views(V, LCS, "SELECT * FROM lc", recursive=True))
def _(s, sf):
    return m.lcs_pairs(*pairs(s, sf))


@query("F11_rouge_l", with_views(V, LCS, "SELECT video_id, round(rouge_l,6) AS rouge_l FROM rv", recursive=True))
def _(s, sf):
    return m.rouge_l(*pairs(s, sf)).select(KEY, *r6("rouge_l"))


@query("F12_meteor_alignment", with_views(V, ALIGN, "SELECT * FROM ma"))
def _(s, sf):
    return m.meteor_alignment(*pairs(s, sf))


@query("F13_meteor", with_views(V, ALIGN, "SELECT video_id, round(meteor,6) AS meteor FROM mv"))
def _(s, sf):
    return m.meteor(*pairs(s, sf)).select(KEY, *r6("meteor"))


ALL = {**cider_ctes(), **COMP, **ALIGN, **LCS}


@query("F14_score_captions", with_views(V, {**ALL,
    "bl": bleu_sql("", f"(SELECT {SUMS} FROM bc)"),
    "mm": """SELECT count(*) AS num_videos, round(avg(meteor),6) AS meteor, round(avg(rouge_l),6) AS rouge_l, round(avg(cider),6) AS cider
             FROM cd JOIN mv USING (video_id) JOIN rv USING (video_id)"""}, "SELECT * FROM mm, bl", recursive=True))  # fmt: skip
def _(s, sf):
    out = evaluation.score_captions(fx.predictions(s, sf), fx.references(s, sf))
    return out.select("num_videos", *r6("meteor", "rouge_l", "cider", *BLEU))


@query("F14_score_per_video", with_views(V, {**ALL, "bl": bleu_sql("video_id, ", "bc")}, """SELECT video_id, round(cider,6) AS cider, bleu_1, bleu_2, bleu_3, bleu_4,
    round(meteor,6) AS meteor, round(rouge_l,6) AS rouge_l FROM cd JOIN bl USING (video_id) JOIN mv USING (video_id) JOIN rv USING (video_id)""", recursive=True))  # fmt: skip
def _(s, sf):
    out = evaluation.score_per_video(fx.predictions(s, sf), fx.references(s, sf))
    return out.select(KEY, *r6("cider", *BLEU, "meteor", "rouge_l"))


@query("F15_missing_ground_truth", with_views(V, {}, "SELECT DISTINCT video_id FROM fx_turns WHERE video_id NOT IN (SELECT video_id FROM fx_refs) OR video_id NOT IN (SELECT video_id FROM fx_pred)"))
def _(s, sf):
    p, r = fx.predictions(s, sf), fx.references(s, sf)
    return m.missing_ground_truth(p, r).unionByName(m.missing_ground_truth(r, p).distinct()).distinct().unionByName(
        m.missing_ground_truth(fx.turns(s, sf), p.select(KEY).unionByName(r.select(KEY))).distinct()
    )


@query("F16_valid_ids", with_views([*V, "fx_videos"], {"cat": "SELECT video_id, category FROM fx_videos WHERE split='test'"},
    """SELECT video_id, cat.category FROM cat WHERE video_id IN (SELECT video_id FROM fx_pred) AND video_id IN (SELECT video_id FROM fx_refs)"""))  # fmt: skip
def _(s, sf):
    return m.valid_ids(fx.predictions(s, sf), fx.references(s, sf), splits.category_map(fx.videos(s, sf)))


BY_CAT = {**cider_ctes("category"), **COMP, **ALIGN, **LCS}
CAT_ROWS = {
    **BY_CAT,
    "bl": bleu_sql("category, ", f"(SELECT category, {SUMS} FROM bc GROUP BY category)"),
    "mm": """SELECT category, count(*) AS num_videos, round(avg(meteor),6) AS meteor, round(avg(rouge_l),6) AS rouge_l, round(avg(cider),6) AS cider
             FROM cd JOIN hp USING (video_id) JOIN mv USING (video_id) JOIN rv USING (video_id) GROUP BY 1""",
    "tl": "SELECT category, count(*) AS num_train_videos, round(avg(end_time-start_time),6) AS avg_train_duration_sec FROM fx_videos WHERE split='train' GROUP BY 1",
}


CAT_ROWS_NO_TRAIN = {k: v for k, v in CAT_ROWS.items() if k != "tl"}


@query("F17_score_by_category", with_views([*V, "fx_videos"], CAT_ROWS, "SELECT * FROM mm JOIN bl USING (category) LEFT JOIN tl USING (category)", recursive=True))
def _(s, sf):
    out = evaluation.score_by_category(fx.predictions(s, sf), fx.references(s, sf), fx.videos(s, sf))
    return out.select(
        "category", "num_videos", *r6("meteor", "rouge_l", "cider", *BLEU), "num_train_videos", *r6("avg_train_duration_sec")
    )


# Two epochs of predictions for the same ids: the first assistant turn of each video, and the last of those with even numbers.
EVEN = "CAST(replace(video_id,'video','') AS BIGINT) % 2 = 0"
LAST = "(SELECT video_id, arg_max(caption, turn) AS caption FROM fx_turns WHERE role='assistant' GROUP BY 1)"
EPOCHS = {
    "hp": f"""SELECT concat(video_id,'#1') AS video_id, 1 AS category, {TOKE} AS t FROM fx_pred WHERE video_id IN (SELECT video_id FROM fx_refs)
              UNION ALL SELECT concat(video_id,'#2'), 2, {TOKE} FROM {LAST} WHERE {EVEN} AND video_id IN (SELECT video_id FROM fx_refs)""",
    "rf": f"""SELECT concat(video_id,'#1') AS video_id, 1 AS category, cap_id, {TOKE} AS t FROM fx_refs WHERE video_id IN (SELECT video_id FROM fx_pred)
              UNION ALL SELECT concat(video_id,'#2'), 2, cap_id, {TOKE} FROM fx_refs WHERE {EVEN} AND video_id IN (SELECT video_id FROM fx_pred)""",
}


def epochs(s, sf) -> tuple[DataFrame, DataFrame]:
    even = F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint") % 2 == 0
    one, two = F.lit(1).alias("epoch"), F.lit(2).alias("epoch")
    last = fx.turns(s, sf).filter("role = 'assistant'").groupBy(KEY).agg(F.max_by("caption", "turn").alias("caption"))
    pred = fx.predictions(s, sf).select(KEY, "caption", one).unionByName(last.filter(even).select(KEY, "caption", two))
    refs = fx.references(s, sf).select(KEY, "cap_id", "caption")
    return m.scored_pairs(pred, refs.select("*", one).unionByName(refs.filter(even).select("*", two)), ["epoch"])


@query("F5_bleu_two_epochs", with_views(V, {**COMP, **EPOCHS}, bleu_sql("epoch, ", f"(SELECT category AS epoch, {SUMS} FROM bc GROUP BY category)")))
def _(s, sf):
    return m.bleu_corpus(*epochs(s, sf), ["epoch"]).select("epoch", *r6(*BLEU))


@query("F9_cider_two_epochs", with_views(V, {**cider_ctes("category"), **EPOCHS}, "SELECT category AS epoch, round(avg(cider),6) AS cider FROM cd JOIN hp USING (video_id) GROUP BY 1"))
def _(s, sf):
    return m.cider_corpus(*epochs(s, sf), ["epoch"]).select("epoch", *r6("cider"))


@query("F14_score_two_epochs", with_views(V, {**CAT_ROWS_NO_TRAIN, **EPOCHS}, "SELECT category AS epoch, * EXCLUDE (category) FROM mm JOIN bl USING (category)", recursive=True))
def _(s, sf):
    out = evaluation.score_captions(*epochs(s, sf), ["epoch"])
    return out.select("epoch", "num_videos", *r6("meteor", "rouge_l", "cider", *BLEU))


@query("F14_per_video_two_epochs", with_views(V, {**BY_CAT, "bl": bleu_sql("video_id, ", "bc"), **EPOCHS}, """SELECT split_part(video_id,'#',1) AS video_id, category AS epoch, round(cider,6) AS cider,
    bleu_1, bleu_2, bleu_3, bleu_4, round(meteor,6) AS meteor, round(rouge_l,6) AS rouge_l
    FROM cd JOIN hp USING (video_id) JOIN bl USING (video_id) JOIN mv USING (video_id) JOIN rv USING (video_id)""", recursive=True))  # fmt: skip
def _(s, sf):
    out = evaluation.score_per_video(*epochs(s, sf), ["epoch"])
    return out.select(KEY, "epoch", *r6("cider", *BLEU, "meteor", "rouge_l"))


@query("F18_rank_categories", with_views(V, {**cider_ctes("category"), "cc": "SELECT category, round(avg(cider),6) AS cider FROM cd JOIN hp USING (video_id) GROUP BY 1",
    "rk": "SELECT *, row_number() OVER (ORDER BY cider DESC, category) AS a, row_number() OVER (ORDER BY cider, category DESC) AS b FROM cc"},
    "SELECT category, cider, 'top' AS side, CAST(a AS INT) AS place FROM rk WHERE a<=5 UNION ALL SELECT category, cider, 'bottom', CAST(b AS INT) FROM rk WHERE b<=5"))
def _(s, sf):
    return m.rank_categories(m.cider_corpus(*pairs(s, sf), ["category"]).select("category", *r6("cider")))


def batch_ctes(hyp: str) -> dict[str, str]:
    ctes = cider_ctes("batch")
    b = f"{NUM}//8 AS batch"
    ctes["hp"] = f"SELECT video_id, {b}, {TOKE} AS t FROM {hyp} WHERE video_id IN (SELECT video_id FROM fx_refs)"
    ctes["rf"] = f"SELECT video_id, {b}, cap_id, {TOKE} AS t FROM fx_refs WHERE video_id IN (SELECT video_id FROM fx_pred)"
    ctes["hg"] = grams("hp", "video_id, batch")
    ctes["rg"] = grams("rf", "video_id, batch, cap_id")
    return ctes


def prefixed(prefix: str, ctes: dict[str, str]) -> dict[str, str]:
    """The same steps under other names."""
    import re

    names = re.compile(r"\b(" + "|".join(ctes) + r")\b(?!\()")
    return {prefix + n: names.sub(lambda x: prefix + x.group(1), q) for n, q in ctes.items()}


def reward_sql(body: str) -> str:
    """The CIDEr steps twice; ``adv`` has both scores of every video."""
    whole = {**prefixed("a_", batch_ctes("last_pred")), **prefixed("b_", batch_ctes("fx_pred"))}
    first = {"last_pred": "SELECT video_id, arg_max(caption, turn) AS caption FROM fx_turns WHERE role='assistant' GROUP BY 1"}
    last = {"adv": "SELECT a.video_id, a_hp.batch, a.cider AS s, b.cider AS g FROM a_cd a JOIN b_cd b USING (video_id) JOIN a_hp USING (video_id)"}
    return with_views(V, {**first, **whole, **last}, body)


@query("F19_reward_advantage", reward_sql(
    "SELECT video_id, batch, round(s,6) AS sampled_cider, round(g,6) AS greedy_cider, round(s-g,6) AS advantage FROM adv"))
def _(s, sf):
    return advantages(s, sf).select(KEY, "batch", *r6("sampled_cider", "greedy_cider", "advantage"))


@query("F19_reward_means", reward_sql("""SELECT batch, count(*) AS videos, round(avg(s),6) AS mean_sampled_cider, round(avg(g),6) AS mean_greedy_cider,
    round(avg(s-g),6) AS mean_advantage FROM adv GROUP BY 1"""))  # fmt: skip
def _(s, sf):
    return m.reward_means(advantages(s, sf)).select("batch", "videos", *r6("mean_sampled_cider", "mean_greedy_cider", "mean_advantage"))


def advantages(s, sf) -> DataFrame:
    said = fx.turns(s, sf).filter("role = 'assistant'")
    batch = F.floor(F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint") / 8)
    greedy, refs = pairs(s, sf)
    last = said.groupBy(KEY).agg(F.max_by("caption", "turn").alias("caption")).join(refs.select(KEY), KEY, "left_semi")
    return m.reward_advantage(last.withColumn("batch", batch), greedy.withColumn("batch", batch), refs.withColumn("batch", batch))


# Category x parity of the id, each alone, and all: every video stands in four groups.
CUBE_SETS = [["category", "even"], ["category"], ["even"], []]


def cube_copies(table: str, columns: str) -> str:
    base = f"(SELECT *, CAST({EVEN} AS INT) AS even FROM {table})"
    keys = ["concat(category,'|',even)", "concat(category,'|')", "concat('|',even)", "'|'"]
    return " UNION ALL ".join(f"SELECT concat(video_id,'#{i}') AS video_id, {key} AS category, {columns} FROM {base}" for i, key in enumerate(keys))


CUBE = {
    "hp0": TOK["hp"], "rf0": TOK["rf"], **CAT_ROWS_NO_TRAIN,
    "hp": cube_copies("hp0", "t"), "rf": cube_copies("rf0", "cap_id, t"),
    "cube": "SELECT nullif(split_part(category,'|',1),'') AS c, nullif(split_part(category,'|',2),'') AS e, * EXCLUDE (category) FROM mm JOIN bl USING (category)",
}


@query("F17_score_grouping_sets", with_views(V, CUBE, """SELECT CASE WHEN c IS NULL THEN 2 ELSE 0 END + CASE WHEN e IS NULL THEN 1 ELSE 0 END AS grouping_set,
    CAST(c AS INT) AS category, CAST(e AS INT) AS even, * EXCLUDE (c, e) FROM cube""", recursive=True))  # fmt: skip
def _(s, sf):
    even = (F.replace(F.col(KEY), F.lit("video"), F.lit("")).cast("bigint") % 2 == 0).cast("int").alias("even")
    p, r = fx.predictions(s, sf).select("*", even), fx.references(s, sf).select("*", even)
    out = evaluation.score_grouping_sets(p, r, CUBE_SETS)
    return out.select("grouping_set", F.col("category").cast("int").alias("category"), "even", "num_videos", *r6("meteor", "rouge_l", "cider", *BLEU))


# --- the whole category evaluation -----------------------------------------

VALID = {
    "val": """SELECT video_id, CAST(arg_max(category, id) AS INT) AS category FROM fx_videos WHERE split='test' AND video_id IN (SELECT video_id FROM fx_pred)
              AND video_id IN (SELECT video_id FROM fx_refs) GROUP BY 1""",
    "hp": f"SELECT p.video_id, val.category, {TOKE} AS t FROM fx_pred p JOIN val ON p.video_id=val.video_id",
    "rf": f"SELECT p.video_id, val.category, cap_id, {TOKE} AS t FROM fx_refs p JOIN val ON p.video_id=val.video_id",
}


def category_report_sql() -> str:
    by = {**CAT_ROWS, **VALID}
    whole = {**cider_ctes(), **COMP, **ALIGN, **LCS, **VALID,
        "bl": bleu_sql("", f"(SELECT {SUMS} FROM bc)"),
        "mm": """SELECT count(*) AS num_videos, round(avg(meteor),6) AS meteor, round(avg(rouge_l),6) AS rouge_l, round(avg(cider),6) AS cider
                 FROM cd JOIN mv USING (video_id) JOIN rv USING (video_id)"""}  # fmt: skip
    order = lambda c: {"val": c["val"], "hp": c["hp"], "rf": c["rf"], **c}
    columns = "num_videos, num_train_videos, avg_train_duration_sec, bleu_1, bleu_2, bleu_3, bleu_4, meteor, rouge_l, cider"
    return with_views([*V, "fx_videos"], {**prefixed("c_", order(by)), **prefixed("o_", order(whole))}, f"""
        SELECT category, {columns} FROM c_mm JOIN c_bl USING (category) LEFT JOIN c_tl USING (category)
        UNION ALL SELECT NULL, {columns.replace("num_train_videos", "NULL").replace("avg_train_duration_sec", "NULL")} FROM o_mm, o_bl""", recursive=True)  # fmt: skip


@query("K7_category_report", category_report_sql())
def _(s, sf):
    """Category evaluation with its overall row, through the written table: all columns."""
    from framelark.functions.storage import scratch_path
    from framelark.sources import sinks

    path = scratch_path(s, "report")
    rows = evaluation.category_report(fx.predictions(s, sf), fx.references(s, sf), fx.videos(s, sf))
    counts = ["category", "num_videos", "num_train_videos"]
    sinks.write_metrics(rows.select(*counts, *r6(*[c for c in sinks.CATEGORY_COLUMNS if c not in counts])), path)
    types = ", ".join(f"{c} {'int' if c == 'category' else 'bigint' if c.startswith('num') else 'double'}" for c in sinks.CATEGORY_COLUMNS)
    return s.read.schema(types).option("header", True).csv(path)
