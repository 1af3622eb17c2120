"""herdframe: identities of animals from detected keypoints, and training-data operators, as Spark jobs."""
