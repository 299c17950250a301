"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

REPORT = "file string, title string, version string, description string, logs array<string>, stack_traces array<string>"
LOG_EVENT = "class string, type string, content string, line string"
SEGMENT = "project string, method_path string, class_name string, method_name string, segment_no int, tokens array<string>"
CALL_GRAPH = (
    "map<string, struct<location: struct<file: string, line: int>, methods: array<map<string, struct<"
    "location: struct<file: string, line: int>, calls: array<struct<callee: string, line: int>>, "
    "logs: array<struct<template: string, level: string, line: int>>>>>>>"
)
CG_METHOD = "version string, class_ord int, method_ord int, class string, method string, file string, line int"
CG_CALL = "version string, class_ord int, method_ord int, call_ord int, method string, callee string, line int"
CG_LOG = "version string, class_ord int, method_ord int, log_ord int, method string, template string, level string, line int"
COVERAGE_RAW = "filePath string, methodSig string, internalCovered int, internalTotal int, coveringTest string"
COVERAGE = "version string, method_sig string, coverage double, covering_tests array<string>"
SCORE = "title string, channel string, method string, score double"
RANKING = "title string, rank int, method string, score double"
TRUTH = "title string, methods array<string>"
METRICS = "system string, count long, accuracy_at_n double, mrr double"
EDGE = "title string, src string, dst string"
CALLABLE = "id long, kind string, class string, name string, signature string, file string, start_line int"
CALL_SITE = "id long, enclosing long, callee long, kind string"
OUTLINE = "doc string, path array<string>, para_no int, text string"
PAGE = "url string, html string"
JAVA_SOURCE = "project string, path string, content string"
