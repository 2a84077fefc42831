"""Files by their names: the reader of a format from the extension of a path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_images, binary_sinks, dicom, text_meshes

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".nii": lambda s, p: binary_images.volumes(s, p, "nifti"),
    ".nii.gz": lambda s, p: binary_images.volumes(s, p, "nifti"),
    ".mha": lambda s, p: binary_images.volumes(s, p, "metaimage"),
    ".nrrd": lambda s, p: binary_images.volumes(s, p, "nrrd"),
    ".dcm": dicom.headers,
    ".zip": dicom.headers,
    ".png": binary_sinks.image_slices,
    ".vtu": text_meshes.vtu_arrays,
    ".mesh": text_meshes.medit,
    ".stl": text_meshes.stl,
    ".X": text_meshes.cheart_values,
    ".D": text_meshes.cheart_values,
    ".T": text_meshes.cheart_topology,
    ".plot": text_meshes.stores,
    ".measure": text_meshes.stores,
    ".seg": text_meshes.stores,
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The frame that the reader for the longest matching extension gives."""
    found = [e for e in READERS if path.endswith(e)]
    if not found:
        raise ValueError(f"no reader for {path!r}")
    return READERS[max(found, key=len)](spark, path)
