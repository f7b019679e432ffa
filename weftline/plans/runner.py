"""Runs described steps: each reads files of the output folder, is one Spark plan, and writes its outputs."""

from __future__ import annotations

import logging
import math
import os
import random
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.corpus import ParallelCorpus
from weftline.errors import ConfigurationError, CorpusError
from weftline.functions.hashing import SegmentHasher
from weftline.operators import steps
from weftline.operators.preprocess import PreprocessorPipeline, tokenized
from weftline.plans.config import substeps
from weftline.plans.pipeline import FilterPipeline
from weftline.sources import text

log = logging.getLogger(__name__)


def log_count(n: int) -> int:
    """A word's damped frequency: the rounded binary logarithm of one more."""
    return int(round(math.log(n + 1, 2)))


#: step -> (keys it needs, keys it may have)
KEYS: dict[str, tuple[str, str]] = {
    "opus_read": ("corpus_name source_language target_language src_output tgt_output", "release preprocessing suppress_prompts source_file target_file"),
    "filter": ("inputs outputs filters", "filterfalse limit n_jobs"),
    "score": ("inputs output filters", "with_decision n_jobs"),
    "preprocess": ("inputs outputs preprocessors", "n_jobs"),
    "concatenate": ("inputs output", ""),
    "head": ("inputs outputs n", ""),
    "tail": ("inputs outputs n", ""),
    "slice": ("inputs outputs", "start stop step"),
    "subset": ("inputs outputs size", "seed shuffle_subset"),
    "split": ("inputs outputs divisor", "outputs_2 threshold compare hash seed"),
    "remove_duplicates": ("inputs outputs", "compare hash overlap lowercase letters_only letter_words_only tokenizers"),
    "product": ("inputs outputs", "skip_empty skip_duplicates k seed"),
    "unzip": ("input outputs separator", ""),
    "join": ("inputs output", "keys"),
    "sort": ("inputs outputs values", "key type combine_operator reverse"),
    "train_bpe": ("input model", "symbols min_frequency num_workers"),
    "train_morfessor": ("input model", "corpusweight min_frequency dampening seed use_skips forcesplit_list nosplit_re"),
    "train_ngram": ("data model", "parameters"),
    "train_alignment": ("src_data tgt_data output", "parameters scores"),
    "train_nearest_neighbors": ("inputs languages output", "n_neighbors algorithm metric"),
    "train_classifier": ("training_scores model criterion features", "dev_scores model_type model_parameters optimization"),
    "classify": ("model scores", "output_probabilities output_labels true_label chunksize"),
    "download": ("output url", ""),
    "write": ("output data", ""),
}


class Runner:
    """``description`` has ``steps`` and perhaps ``common`` (output_directory, constants). ``embed`` serves embedding steps."""

    def __init__(self, spark: SparkSession, description: dict[str, Any], embed: Callable[..., Any] | None = None) -> None:
        common = description.get("common") or {}
        self.spark, self.steps, self.embed = spark, description.get("steps") or [], embed
        self.folder, self.constants = common.get("output_directory") or ".", common.get("constants") or {}
        os.makedirs(self.folder, exist_ok=True)

    def run(self, overwrite: bool = False, last: int | None = None) -> None:
        """All steps, or those up to the number ``last``."""
        for step in self.steps[:last]:
            self._step(step, overwrite)

    def run_one(self, number: int, overwrite: bool = False) -> None:
        """The step of a number from 1, or from the end if negative."""
        self._step(self.steps[number if number < 0 else number - 1], overwrite)

    def _step(self, step: dict[str, Any], overwrite: bool) -> None:
        kind = step.get("type")
        if kind not in KEYS:
            raise ConfigurationError(f"unknown step: {kind}")
        for parameters in substeps(step, self.constants):
            need, may = (set(k.split()) for k in KEYS[kind])
            if missing := need - set(parameters):
                raise ConfigurationError(f"{kind} lacks {', '.join(sorted(missing))}")
            if extra := set(parameters) - need - may:
                raise ConfigurationError(f"{kind} doesn't know {', '.join(sorted(extra))}")
            outputs = [parameters[k] for k in ("output", "model", "src_output", "tgt_output", "output_probabilities", "output_labels") if k in parameters and not (k == "model" and kind == "classify")]
            outputs += [*parameters.get("outputs", []), *parameters.get("outputs_2", [])]
            if not overwrite and outputs and all(os.path.exists(self.path(o)) for o in outputs):
                log.info("%s: outputs exist, skipped", kind)
                continue
            getattr(self, f"do_{kind}")(parameters)

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _read(self, names: list[str], strip: bool = True) -> ParallelCorpus:
        return text.read_parallel(self.spark, *map(self.path, names), strip=strip)

    def _write(self, corpus: ParallelCorpus, names: list[str]) -> None:
        ready = corpus.df.persist()  # every language's file is written from one computation
        try:
            text.write_parallel(ParallelCorpus(ready, corpus.n), list(map(self.path, names)))
        finally:
            ready.unpersist()

    def _scores(self, name: str) -> Any:
        return text.read_json_lines(self.spark, self.path(name))

    def _pipeline(self, config: list[dict[str, Any]]) -> FilterPipeline:
        if self.embed is not None:
            config = [{k: {**v, "embed": self.embed} if k == "SentenceEmbeddingFilter" else v for k, v in item.items()} for item in config]
        return FilterPipeline.of(config, self.folder)

    def do_filter(self, p: dict[str, Any]) -> None:
        pipeline, corpus = self._pipeline(p["filters"]), self._read(p["inputs"])
        out = pipeline.filterfalse(corpus) if p.get("filterfalse") else pipeline.filter(corpus)
        self._write(steps.head(out, p["limit"]) if p.get("limit") else out, p["outputs"])

    def do_score(self, p: dict[str, Any]) -> None:
        found = self._pipeline(p["filters"]).score(self._read(p["inputs"]), p.get("with_decision", False))
        text.write_json_lines(found, self.path(p["output"]))

    def do_preprocess(self, p: dict[str, Any]) -> None:
        self._write(PreprocessorPipeline.of(p["preprocessors"], self.folder).process(self._read(p["inputs"])), p["outputs"])

    def do_concatenate(self, p: dict[str, Any]) -> None:
        self._write(steps.concatenate(*(self._read([n]) for n in p["inputs"])), [p["output"]])

    def do_head(self, p: dict[str, Any]) -> None:
        self._write(steps.head(self._read(p["inputs"], False), p["n"]), p["outputs"])

    def do_tail(self, p: dict[str, Any]) -> None:
        self._write(steps.tail(self._read(p["inputs"], False), p["n"]), p["outputs"])

    def do_slice(self, p: dict[str, Any]) -> None:
        self._write(steps.slice_lines(self._read(p["inputs"], False), p.get("start", 0), p.get("stop"), p.get("step", 1)), p["outputs"])

    def do_subset(self, p: dict[str, Any]) -> None:
        self._write(steps.subset(self._read(p["inputs"], False), p["size"], p.get("seed"), p.get("shuffle_subset", False)), p["outputs"])

    def do_split(self, p: dict[str, Any]) -> None:
        hasher = SegmentHasher(p.get("compare", "all"), p.get("hash", "xxh64"), p.get("seed", 0))
        one, two = steps.split(self._read(p["inputs"], False), p["divisor"], p.get("threshold", 1), hasher)
        self._write(one, p["outputs"])
        if p.get("outputs_2"):
            self._write(two, p["outputs_2"])

    def do_remove_duplicates(self, p: dict[str, Any]) -> None:
        names = p.get("tokenizers")
        tokenize = (lambda c, i: tokenized(c, names[i])) if names else None
        hasher = SegmentHasher(p.get("compare", "all"), p.get("hash", "xxh64"), 0, p.get("lowercase", False), p.get("letters_only", False), p.get("letter_words_only", False), tokenize)
        corpus = self._read(p["inputs"], False)
        other = p.get("overlap")
        if other and len(other) != len(p["inputs"]):
            raise ConfigurationError("as many overlap files as inputs are needed")
        self._write(steps.remove_overlap(corpus, self._read(other, False), hasher) if other else steps.remove_duplicates(corpus, hasher), p["outputs"])

    def do_product(self, p: dict[str, Any]) -> None:
        sides = [self._read(names, False) for names in p["inputs"]]
        self._write(steps.product(sides, p.get("skip_empty", True), p.get("skip_duplicates", True), p.get("k"), p.get("seed")), p["outputs"])

    def do_unzip(self, p: dict[str, Any]) -> None:
        self._write(steps.unzip(text.read_lines(self.spark, self.path(p["input"])), p["separator"], len(p["outputs"])), p["outputs"])

    def do_join(self, p: dict[str, Any]) -> None:
        text.write_json_lines(steps.join_scores([self._scores(n) for n in p["inputs"]], p.get("keys")), self.path(p["output"]))

    def do_sort(self, p: dict[str, Any]) -> None:
        by = text.read_values(self.spark, self.path(p["values"]), p.get("key"), p.get("type", ""), p.get("combine_operator"))
        self._write(steps.sort(self._read(p["inputs"]), by, p.get("reverse", False)), p["outputs"])

    def do_train_bpe(self, p: dict[str, Any]) -> None:
        from weftline.operators import subwords

        subwords.train(self._read([p["input"]]).df, self.path(p["model"]), "s0", p.get("symbols", 10_000), p.get("min_frequency", 2))

    def do_train_morfessor(self, p: dict[str, Any]) -> None:
        try:
            import morfessor
        except ImportError as error:
            raise ConfigurationError("train_morfessor needs the library morfessor") from error
        from weftline.operators.subwords import word_counts

        least, dampening = p.get("min_frequency", 1), p.get("dampening", "log") or "none"
        modifiers = {"none": None, "log": log_count, "ones": lambda x: 1, "types": lambda x: 1}
        if dampening not in modifiers:
            raise ConfigurationError(f"unknown dampening: {dampening}")
        if p.get("seed") is not None:
            random.seed(p["seed"])
        words = self._read([p["input"]]).df
        words = words.withColumn("s0", F.lower("s0")) if p.get("lowercase") else words
        counts = [(r["n"], tuple(r["word"])) for r in word_counts(words).where(F.col("n") >= least).toLocalIterator()]
        model = morfessor.BaselineModel(corpusweight=p.get("corpusweight", 1.0), use_skips=p.get("use_skips", True), forcesplit_list=p.get("forcesplit_list"), nosplit_re=p.get("nosplit_re"))
        model.load_data(counts, count_modifier=modifiers[dampening])
        model.train_batch()
        morfessor.MorfessorIO().write_binary_model_file(self.path(p["model"]), model)

    def do_train_ngram(self, p: dict[str, Any]) -> None:
        from weftline.operators import language_models

        options = dict(p.get("parameters") or {})
        own = {k: options[k] for k in ("segmentation", "mb", "wb") if k in options}
        cutoffs = [int(x) for x in str(options.get("cutoffs", "0 0 1")).split()]
        language_models.train(self._read([p["data"]]).df, self.path(p["model"]), "s0", options.get("norder") or 4, cutoffs=cutoffs, parameters=own)

    def do_train_alignment(self, p: dict[str, Any]) -> None:
        from weftline.operators import alignment

        corpus = self._read([p["src_data"], p["tgt_data"]])
        options = p.get("parameters") or {}
        kinds = (options.get("src_tokenizer"), options.get("tgt_tokenizer"))
        ready = corpus.map(lambda c, i: tokenized(c, kinds[i]) if kinds[i] else c)
        alignment.train_priors(ready.where((F.col("s0") != "") & (F.col("s1") != "")), self.path(p["output"]))
        if p.get("scores"):
            own = alignment.WordAlignFilter(src_tokenizer=kinds[0], tgt_tokenizer=kinds[1])
            text.write_json_lines(own.score_frame(corpus).select("idx", F.struct(F.col("score").alias("WordAlignFilter")).alias("score")), self.path(p["scores"]))

    def do_train_nearest_neighbors(self, p: dict[str, Any]) -> None:
        from weftline.operators import embeddings

        if self.embed is None:
            raise ConfigurationError("an embedding function is needed")
        embeddings.train_nearest_neighbors(self._read(p["inputs"]), p["languages"], self.path(p["output"]), self.embed, p.get("n_neighbors", 4))

    def do_train_classifier(self, p: dict[str, Any]) -> None:
        from weftline.operators.classify import Trainer

        dev = steps.flatten(self._scores(p["dev_scores"])) if p.get("dev_scores") else None
        trainer = Trainer(steps.flatten(self._scores(p["training_scores"])), p["features"], dev, p.get("model_type"), p.get("model_parameters"))
        search = p.get("optimization") or {}
        model, value, quantiles, _ = trainer.find(p["criterion"], search.get("algorithm", "default"), search.get("options"))
        log.info("criterion %s, quantiles %s", value, quantiles)
        model.save(self.path(p["model"]))

    def do_classify(self, p: dict[str, Any]) -> None:
        from weftline.operators.classify import Classifier, roc_auc

        scores = steps.flatten(self._scores(p["scores"]))
        found = Classifier.load(self.path(p["model"])).classify(scores)
        if p.get("true_label"):
            known = scores.select("idx", F.col(f"`{p['true_label']}`").cast("int").alias("truth"))
            both = found.join(known, "idx")
            share = both.agg(F.avg((F.col("label") == F.col("truth")).cast("double"))).first()[0]
            log.info("accuracy %s, area under the curve %s", share, roc_auc(both.select(F.col("truth").alias("label"), F.col("probability").alias("p"))))
        if p.get("output_probabilities"):
            text.write_lines(found.select("idx", F.format_string("%.10f", "probability").alias("value")), "value", self.path(p["output_probabilities"]))
        if p.get("output_labels"):
            text.write_lines(found, "label", self.path(p["output_labels"]))

    def do_opus_read(self, p: dict[str, Any]) -> None:
        """From files that were fetched before (``source_file``, ``target_file``): fetching itself needs a network and a library."""
        if not (p.get("source_file") and p.get("target_file")):
            raise CorpusError("name the fetched files as source_file and target_file")
        self._write(self._read([p["source_file"], p["target_file"]]), [p["src_output"], p["tgt_output"]])

    def do_download(self, p: dict[str, Any]) -> None:
        text.download(p["url"], self.path(p["output"]))

    def do_write(self, p: dict[str, Any]) -> None:
        text.write_literal(self.path(p["output"]), p["data"])
