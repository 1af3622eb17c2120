"""Project configuration on the driver: YAML with comments, its rules, and the skeleton as a tree."""

import json
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from herdframe.schemas import SKELETON

#: The sections of a project's options, with defaults and what they mean.
SECTIONS = {
    "anatomy": {
        "bodyparts": (["BODYPART1", "BODYPART2", "BODYPART3"], "names of all keypoints, in the order of the detections"),
        "skeleton": ([["BODYPART1", "BODYPART2"], ["BODYPART2", "BODYPART3"]], "edges of a tree over the keypoints"),
        "root_node": ("BODYPART1", "keypoint at the top of the tree"),
        "root_edge": (["BODYPART1", "BODYPART2"], "edge that gives the heading, from back to front"),
        "individuals": (["animal1", "animal2"], "names of the animals that identity scores are for"),
    },
    "fitting": {
        "num_sample_poses": (500, "poses for the prior"),
        "num_sample_sessions": (10, "sessions that they come from"),
        "num_iters": (500, "steps of expectation maximisation"),
        "num_states": (50, "states of the mixture of directions"),
        "max_distance_std": (3.0, "bones further from their mean length, in deviations, are left out"),
        "min_confidence": (0.5, "detections below aren't used for the prior"),
    },
    "modeling": {
        "num_animals": (2, "animals in a recording"),
        "obs_outlier_variance": (1e6, "of detections that are wrong"),
        "obs_inlier_variance": (10.0, "of detections that are right"),
        "pos_dt_variance": (5.0, "of a keypoint's move between frames"),
        "num_leapfrog_steps": (5, "of the sampler"),
        "hmc_step_size": (0.5, "of the sampler"),
        "seg_length": (10000, "frames of a segment"),
        "session_name_suffix": ("", "cut from recordings' names"),
        "video_dir": ("", "where videos lie"),
        "verbose": (True, "report progress"),
    },
}
FILE = "config.yml"


def defaults() -> dict:
    return {k: v for section in SECTIONS.values() for k, (v, _) in section.items()}


def generate_config(project: str, **options) -> None:  # noqa: ANN003
    """Writes the file; options that no section has are left out."""
    values = defaults() | {k: v for k, v in options.items() if k in defaults()}
    lines = []
    for name, section in SECTIONS.items():
        lines.append(f"# {name} ".ljust(80, "-"))
        for key, (_, comment) in section.items():
            lines += [f"# {comment}", f"{key}: {json.dumps(values[key])}", ""]
    Path(project, FILE).write_text("\n".join(lines))


@dataclass
class Tree:
    """Keypoints in preorder from the root: order[k] is a keypoint's place among the body parts, parents[k] its parent's k."""

    names: list[str]
    order: list[int]
    parents: list[int]


def node_hierarchy(bodyparts: list[str], skeleton: list[list[str]], root: str) -> Tree:
    """The skeleton as a tree; ValueError if it isn't one over all body parts."""
    if len(set(bodyparts)) < len(bodyparts):
        raise ValueError("body parts are named twice")
    if unknown := ({p for e in skeleton for p in e} | {root}) - set(bodyparts):
        raise ValueError(f"not body parts: {sorted(unknown)}")
    near: dict[str, list[str]] = {p: [] for p in bodyparts}
    for a, b in skeleton:
        near[a].append(b)
        near[b].append(a)
    names, above, todo = [], {}, [(root, root)]
    while todo:
        node, parent = todo.pop()
        if node in above:
            raise ValueError(f"the skeleton has a cycle through {node}")
        above[node] = parent
        names.append(node)
        todo += [(p, node) for p in reversed(near[node]) if p != parent]
    if missing := [p for p in bodyparts if p not in above]:
        raise ValueError(f"the skeleton doesn't reach {missing}")
    if len(skeleton) != len(bodyparts) - 1:
        raise ValueError("the skeleton has an edge twice")
    place = {p: k for k, p in enumerate(names)}
    return Tree(names, [bodyparts.index(p) for p in names], [place[above[p]] for p in names])


def config_errors(config: dict) -> list[str]:
    """Every rule that the configuration breaks."""
    parts, errors = set(config.get("bodyparts", [])), []
    if strange := {p for e in config.get("skeleton", []) for p in e} - parts:
        errors.append(f"skeleton: {sorted(strange)} are not among bodyparts")
    if config.get("root_node") not in parts:
        errors.append("root_node is not among bodyparts")
    edge = list(config.get("root_edge", []))
    if edge not in [list(e) for e in config.get("skeleton", [])] and edge[::-1] not in [list(e) for e in config.get("skeleton", [])]:
        errors.append("root_edge is not an edge of the skeleton")
    if not strange and config.get("root_node") in parts:
        try:
            node_hierarchy(config["bodyparts"], config["skeleton"], config["root_node"])
        except ValueError as e:
            errors.append(str(e))
    return errors


def load_config(project: str, check: bool = True) -> dict:
    """The options with `parents`, `node_order` and `indices_egocentric`; ValueError with all broken rules if asked to check."""
    config = yaml.safe_load(Path(project, FILE).read_text())
    if check and (errors := config_errors(config)):
        raise ValueError("; ".join(errors))
    tree = node_hierarchy(config["bodyparts"], config["skeleton"], config["root_node"])
    edge = set(config["root_edge"])
    return config | {"parents": tree.parents, "node_order": tree.order, "indices_egocentric": [k for k, p in enumerate(tree.names) if p in edge]}


def update_config(project: str, **options) -> None:  # noqa: ANN003
    generate_config(project, **(yaml.safe_load(Path(project, FILE).read_text()) | options))


def setup_project(project: str, overwrite: bool = False, deeplabcut_config: str | None = None, **options) -> bool:  # noqa: ANN003
    """Makes the folder and its configuration, from a DeepLabCut project's if one is given; False if it is there already."""
    if Path(project).exists() and not overwrite:
        return False
    found = {}
    if deeplabcut_config:
        dlc = yaml.safe_load(Path(deeplabcut_config).read_text())
        if not dlc.get("multianimalproject") or not dlc.get("identity"):
            raise ValueError("needs a multi-animal project with identity")
        found = {"bodyparts": dlc["multianimalbodyparts"], "skeleton": dlc["skeleton"], "individuals": dlc["individuals"], "video_dir": str(Path(dlc["project_path"], "videos"))}
    Path(project).mkdir(parents=True, exist_ok=True)
    generate_config(project, **(found | options))
    return True


def skeleton_table(spark: SparkSession, tree: Tree) -> DataFrame:
    return spark.createDataFrame([(k, n, s, p) for k, (n, s, p) in enumerate(zip(tree.names, tree.order, tree.parents, strict=True))], SKELETON)
