"""Human corrections: capture, search, per-file retrieval, before/after (C1 C2 P5 P6 J3 A7 J10 EM3).

Correction search (P6) keeps the reference rule exactly: a question's words
are ``lower(text).split()`` with more than two characters, and a correction
matches when **any** word is a substring of ``lower(original + " " +
corrected + " " + target_id)``.  That is a theta join; here it runs as an
equi-join without pairing every question with every correction:

1. every correction text sends each of its distinct trigrams once, and only
   those that occur in some question word;
2. each distinct word is looked up by its rarest trigram;
3. each candidate is confirmed by looking for the whole word in the whole
   text, so the result is exact.

``correction_postings`` gives the matches in factorised form (word to
correction); ``search_corrections`` expands them to (question, correction) pairs, for
tables of selective questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

WORD_SPLIT = r"(?U)[\s\x1C-\x1F]+"  # white space as Python's split() knows it
MIN_WORD_LEN = 3  # words with more than two characters


def question_words(questions: DataFrame, id_col: str = "question_id",
                   text_col: str = "text") -> DataFrame:
    """``(question_id, word)``: distinct lower-cased whitespace tokens longer than two chars."""
    return (questions.select(F.col(id_col).alias("question_id"),
                             F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                                               WORD_SPLIT)).alias("word"))
            .filter(F.length("word") >= MIN_WORD_LEN).distinct())


def searchable_text(corrections: DataFrame) -> DataFrame:
    """``(correction_id, s)`` with s = lower(original || ' ' || corrected || ' ' || target_id)."""
    def nz(c):
        return F.coalesce(F.col(c), F.lit(""))
    return corrections.select(
        "correction_id",
        F.lower(F.concat_ws(" ", nz("original"), nz("corrected"), nz("target_id"))).alias("s"))


def _trigrams(text) -> F.Column:
    """Distinct trigrams of a text of at least MIN_WORD_LEN characters."""
    # characters of an array are found at once; `substring` would count from the start of the text each time
    return F.array_distinct(F.transform(F.array(F.split(F.col(text), "")), lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2])))[0])


def word_matches(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """``(word, correction_id)`` for every word that occurs in a correction's searchable text."""
    s = searchable_text(corrections)
    w = cut_lineage(words.select("word").distinct())
    wt = cut_lineage(w.filter(F.length("word") >= MIN_WORD_LEN).select("word", F.explode(_trigrams("word")).alias("tri")))
    # a text sends each of its trigrams once, and only those that some word has
    ct = cut_lineage(s.filter(F.length("s") >= MIN_WORD_LEN).select("correction_id", F.explode(_trigrams("s")).alias("tri"))
                     .join(wt.select("tri").distinct(), "tri", "left_semi"))
    freq = ct.groupBy("tri").agg(F.count(F.lit(1)).alias("freq"))
    # the rarest trigram of each word; a word with a trigram that no text has matches nothing
    anchor = (wt.join(freq, "tri", "left").fillna(0, subset=["freq"])
              .groupBy("word").agg(F.min(F.struct("freq", "tri")).alias("a"))
              .filter("a.freq > 0").select("word", F.col("a.tri").alias("tri")))
    cand = anchor.join(ct, "tri").select("word", "correction_id")
    # the text travels once, to its candidates, and the whole word is looked for in it
    return cand.join(s, "correction_id").filter(F.expr("contains(s, word)")).select("word", "correction_id").distinct()


def matches_of_states(words: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``(word, correction_id, old, new)``: the matches of two states of the corrections, and in which of them they are.

    A correction whose text is the same in both states is looked for once.
    """
    cols = ["correction_id", "original", "corrected", "target_id"]
    tagged = (before.select(*cols, F.lit(True).alias("old"), F.lit(False).alias("new"))
              .unionByName(after.select(*cols, F.lit(False).alias("old"), F.lit(True).alias("new"))))
    version = F.struct("correction_id", F.sha2(F.to_json(F.struct(*cols[1:])), 256).alias("text"))
    states = cut_lineage(tagged.filter("correction_id IS NOT NULL").groupBy(*cols).agg(F.max("old").alias("old"), F.max("new").alias("new"))
                         .withColumn("correction_id", version))
    return (word_matches(words, states).join(states.select("correction_id", "old", "new"), "correction_id")
            .groupBy("word", F.col("correction_id.correction_id").alias("correction_id")).agg(F.max("old").alias("old"), F.max("new").alias("new")))


def new_matches(questions: DataFrame, before: DataFrame, after: DataFrame,
                id_col: str = "question_id", text_col: str = "text") -> DataFrame:
    """``search_corrections`` of ``after`` without the pairs that it finds in ``before``.

    A correction all of whose words it had before has no such pair, so only the others are joined to the questions,
    and each pair is made once.
    """
    qw = cut_lineage(question_words(questions, id_col, text_col))
    hits = cut_lineage(matches_of_states(qw, before, after))
    gained = hits.filter("new AND NOT old").select("correction_id").distinct()
    return (qw.join(hits.join(gained, "correction_id", "left_semi"), "word")
            .groupBy("question_id", "correction_id").agg(F.max("old").alias("old"), F.max("new").alias("new"))
            .filter("new AND NOT old").select("question_id", "correction_id"))


def correction_postings(questions: DataFrame, corrections: DataFrame, id_col: str = "question_id",
                        text_col: str = "text") -> DataFrame:
    """P6 in factorised form: ``(word, correction_id, n_questions)``.

    The matches of all questions are ``question_words`` joined to these postings on the
    word; the postings grow with words and corrections, while the pairs of
    common words grow with questions times corrections.
    """
    qw = cut_lineage(question_words(questions, id_col, text_col))
    n = qw.groupBy("word").agg(F.count(F.lit(1)).alias("n_questions"))
    return word_matches(qw, corrections).join(n, "word").select("word", "correction_id", "n_questions")


def search_corrections(questions: DataFrame, corrections: DataFrame,
                       id_col: str = "question_id", text_col: str = "text") -> DataFrame:
    """P6 for a table of questions: ``(question_id, correction_id)`` pairs that match."""
    qw = question_words(questions, id_col, text_col)
    hits = word_matches(qw, corrections)
    return qw.join(hits, "word").select("question_id", "correction_id").distinct()


def corrections_for_targets(targets: DataFrame, corrections: DataFrame,
                            target_col: str = "target_id") -> DataFrame:
    """Corrections whose target_id is in the given table (semi join)."""
    return corrections.join(targets.select(F.col(target_col).alias("target_id")).distinct(),
                            "target_id", "left_semi")


def corrections_by_file(files: DataFrame, nodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """J3 + A7: corrections of the nodes of the given source files, one row each.

    ``files(source_file)`` ⋈ ``nodes(node_id, source_file)`` ⋈
    ``corrections(target_id = node_id)``; rows, not a per-file list, so a
    file with very many corrections never becomes one value.  Sort by
    ``(source_file, captured_at, correction_id)`` for presentation.
    """
    f = files.select("source_file").distinct()
    n = nodes.select("node_id", "source_file").join(f, "source_file", "left_semi")
    return (n.join(corrections.withColumnRenamed("target_id", "node_id"), "node_id")
            .select("source_file", "node_id", "correction_id", "original", "corrected"))


def capture_from_dialogue(turns: DataFrame, target: F.Column | None = None) -> DataFrame:
    """A user turn that follows an assistant turn becomes a correction.

    ``turns(conv_id, turn, role, text)``.  The previous turn of the same
    conversation is the original statement, the user turn the correction.
    The previous turn comes from ``previous_in_order`` (global sort), not a
    window per conversation, so one very long conversation is not one task.
    """
    from graphloom.operators.ledger import previous_in_order
    t = (previous_in_order(turns.select("conv_id", "turn", "role", "text"), "conv_id", "turn",
                           ["role", "text"])
         .filter((F.col("role") == "user") & (F.col("prev_role") == "assistant")))
    cid = F.col("conv_id").cast("string")
    return t.select(
        F.concat(cid, F.lit("-"), F.col("turn").cast("string")).alias("correction_id"),
        cid.alias("session_id"),
        F.lit("node").alias("target_type"),
        (target if target is not None else F.concat(F.lit("conv:"), cid)).alias("target_id"),
        F.col("prev_text").alias("original"),
        F.col("text").alias("corrected"),
        F.col("conv_id"), F.col("turn"))


def with_correction_context(chunks: DataFrame, by_file: DataFrame) -> DataFrame:
    """EM3 / GR12: attach earlier corrections to the chunks they concern.

    ``chunks(node_id, source_file, ...)`` and ``by_file`` from
    ``corrections_by_file``; the result has one row per (chunk, correction)
    plus the chunks without any (left join on the node, so a file's chunks
    never meet all corrections of the file), ready for a summariser that
    takes corrections as extra input.  No per-file list is built.
    """
    c = by_file.select("node_id", "correction_id", "original", "corrected")
    return chunks.join(c, "node_id", "left")


def community_corrections(members: DataFrame, corrections: DataFrame) -> DataFrame:
    """GR12: corrections of a community's members, as rows ``(community_id, node_id, correction)``."""
    return (members.select("community_id", "node_id")
            .join(corrections.withColumnRenamed("target_id", "node_id"), "node_id")
            .select("community_id", "node_id", "correction_id", "original", "corrected"))
