"""The search loop: a small state on the driver, one job per round over the beam."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bayes


@dataclass
class SearchSession:
    """Finds a target among vectors (id, text_vec, visual_vec) by asking questions.

    embed turns a question's text into a vector. Only scalars and the top candidates reach the driver; the beam, at
    most beam_size rows, is a local table.
    """

    vectors: DataFrame
    embed: Callable[[str], list[float]]
    beam_size: int = bayes.BEAM
    top: int = bayes.TOP
    least_gain: float = bayes.LEAST_GAIN
    most_rounds: int = 8
    least_rounds: int = 2
    round: int = 0
    reason: str | None = None
    history: list[tuple[int, str, float | None]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    beam: DataFrame | None = None

    def start(self, hint: str | None = None) -> SearchSession:
        ids = bayes.top_by_cosine(self.vectors, "text_vec", self.embed(hint), self.beam_size).select("id") if hint else bayes.scroll(self.vectors, self.beam_size)
        self.beam = self._kept(bayes.uniform(ids))
        return self

    def _kept(self, beam: DataFrame) -> DataFrame:
        spark = beam.sparkSession
        return spark.createDataFrame([(r.id, r.prob) for r in beam.limit(self.beam_size).collect()], "id long, prob double")

    def _questions(self, texts: list[str]) -> DataFrame:
        return self.vectors.sparkSession.createDataFrame([(i, t, [float(x) for x in self.embed(t)]) for i, t in enumerate(texts)], "question_id int, question string, vec array<double>")

    def next_question(self, candidates: list[str]) -> str | None:
        """The candidate question of most information; None ends the search and sets the reason."""
        self.round += 1
        members = self.vectors.join(F.broadcast(self.beam), "id").cache()
        top = members.orderBy(F.desc("prob"), "id").limit(self.top)
        if bayes.diversity(top, "visual_vec").first()[0] < bayes.HOMOGENEOUS and self.round >= self.least_rounds:
            self.reason = "homogeneous"
            return None
        asked = [c for c in candidates if c not in self.skipped]
        if not asked:
            self.reason = "low_ig"
            return None
        q = self._questions(asked)
        gains = bayes.information_gain(bayes.normalised(self.beam), bayes.scores(members.select("id", "text_vec", "visual_vec"), q))
        if self.skipped:
            gains = bayes.penalised(gains, q, self._questions(self.skipped))
        best = bayes.best_question(gains).first()
        members.unpersist()
        if best is None or (best.info_gain < self.least_gain and self.round >= self.least_rounds):
            self.reason = "low_ig"
            return None
        return asked[best.question_id]

    def answer(self, question: str, value: float | None) -> str | None:
        """Take an answer in [0, 1] or None for unknown. Returns the reason if the search is over."""
        self.history.append((self.round, question, value))
        if value is None:
            self.skipped.append(question)
        else:
            members = self.vectors.join(F.broadcast(self.beam.select("id")), "id")
            scored = bayes.scores(members, self._questions([question]))
            beam = bayes.normalised(bayes.update(self.beam, scored, value))
            self.beam = self._kept(bayes.pruned(beam, self.beam_size))
            if bayes.beam_stats(self.beam).first().collapsed:
                self.beam = self._kept(bayes.uniform(bayes.scroll(self.vectors, self.beam_size)))
        most = bayes.beam_stats(self.beam).first().max_prob
        if most >= bayes.CERTAIN:
            self.reason = "confidence"
        elif self.round >= self.most_rounds:
            self.reason = "max_rounds" if most >= bayes.PRESENT else "not_in_library"
        return self.reason

    def results(self, k: int = 5) -> DataFrame:
        return bayes.pruned(self.beam, k)
