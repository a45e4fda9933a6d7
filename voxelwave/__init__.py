"""voxelwave: a PySpark-native engine for multichannel signals, tensors, volumes and meshes."""

__version__ = "0.1.0"
