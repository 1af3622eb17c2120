"""Schemas of the long form: one row a detection, score or assignment. Missing values are NULL, never NaN."""

SERIES = ["recording", "camera", "keypoint", "instance"]
CELL = ["recording", "frame", "keypoint"]
VIEW = ["recording", "frame", "camera"]

DETECTIONS = "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double"
IDENTITIES = "recording string, camera long, frame long, keypoint long, instance long, animal long, weight double"
AFFINITIES = "recording string, camera long, frame long, keypoint long, instance long, parent_instance long, weight double"
SKELETON = "keypoint long, name string, source_index long, parent long"
CALIBRATION = "camera long, name string, rotation array<array<double>>, translation array<double>, intrinsic array<array<double>>, dist_coefs array<double>, projection array<array<double>>"
MATCHED_FRAMES = "sync_idx long, camera long, frame long"
POSES = "pose_id long, keypoint long, x double, y double, z double"
RECORDINGS = "recording string, camera long, path string"
