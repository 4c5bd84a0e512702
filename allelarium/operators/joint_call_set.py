"""Two call sets as one object: their overlaps, kept after the first use, and their concordance.

Sample ids must be unique on each side; a duplicate is refused when the object
is made. The overlaps are persisted when they are first asked for and given
back by `close`, which a `with` block calls at its end; a closed object refuses
further work. Call sets without samples or variants have empty overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelarium.model import CallSet, Variable
from allelarium.operators import concordance, joint
from allelarium.operators.joint import JoinType
from allelarium.operators.views import ConcordanceTable


class JointCallSet:
    def __init__(self, exo: CallSet, imp: CallSet):
        joint.check_samples(exo, imp)
        self.exo, self.imp = exo, imp
        self._kept: dict[str, DataFrame] = {}
        self._closed = False

    def _open(self) -> None:
        if self._closed:
            raise ValueError("the joint call set is closed")

    def _cached(self, name: str, make) -> DataFrame:
        self._open()
        if name not in self._kept:
            self._kept[name] = make(self.exo, self.imp).persist()
        return self._kept[name]

    def sample_overlaps(self) -> DataFrame:
        """(s, EXOME, IMPUTATION) of every sample."""
        return self._cached("samples", joint.sample_overlaps)

    def variant_overlaps(self) -> DataFrame:
        """(contig, position, alleles, EXOME, IMPUTATION) of the variants in both."""
        return self._cached("variants", joint.variant_overlaps)

    def n_sample_overlaps(self) -> int:
        return self.sample_overlaps().where(F.col("EXOME") & F.col("IMPUTATION")).count()

    def n_variant_overlaps(self) -> int:
        return self.variant_overlaps().count()

    def global_concordance(self, groups: list[Variable] = (), aggs: list[Variable] = (), join_type: JoinType = JoinType.inner) -> ConcordanceTable:
        self._open()
        return concordance.global_concordance(self.exo, self.imp, groups, aggs, join_type)

    def variant_concordance(self, groups: list[Variable] = (), aggs: list[Variable] = (), join_type: JoinType = JoinType.inner) -> ConcordanceTable:
        self._open()
        return concordance.variant_concordance(self.exo, self.imp, groups, aggs, join_type)

    def sample_concordance(self, join_type: JoinType = JoinType.inner) -> ConcordanceTable:
        self._open()
        return concordance.sample_concordance(self.exo, self.imp, join_type)

    def close(self) -> None:
        """Give back what is kept; more calls do nothing."""
        for frame in self._kept.values():
            frame.unpersist()
        self._kept.clear()
        self._closed = True

    def __enter__(self) -> JointCallSet:
        self._open()
        return self

    def __exit__(self, *_) -> None:
        self.close()
