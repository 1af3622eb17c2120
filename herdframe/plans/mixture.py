"""A fixed start of two states for one step of expectation maximisation."""

MIXTURE = [{"pi": 0.5, "bones": {k: ([1.0, 0.0, 0.0], 1.0) for k in (1, 2, 3)}}, {"pi": 0.5, "bones": {k: ([0.0, 0.6, 0.8], 2.0) for k in (1, 2, 3)}}]
#: The same in the image, bones' lengths, and frames of a segment, for the pose model.
FLAT_MIXTURE = [{"pi": 0.5, "bones": {1: ([0.6, 0.8], 2.0), 2: ([1.0, 0.0], 1.5), 3: ([0.0, 1.0], 3.0)}}, {"pi": 0.5, "bones": {1: ([-0.8, 0.6], 4.0), 2: ([0.0, -1.0], 1.0), 3: ([0.6, -0.8], 2.5)}}]
POSE_RADII, POSE_SEGMENT = [0.0, 60.0, 55.0, 70.0], 32
