"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

parse = T._parse_datatype_string

DETECTION = "sequence_id string, frame_index bigint, class string, x1 double, y1 double, x2 double, y2 double, conf double, track_id bigint"
TRACKING = ("sequence_id string, frame_index bigint, timestamp_s double, track_id bigint, team_label string, role string, x_m double, y_m double, "
            "position_valid boolean, team_confidence double")
CALIBRATION = "sequence_id string, frame_index bigint, keyframe boolean, cal_valid boolean, h array<double>"
EVENT = ("sequence_id string, event_id string, start_frame bigint, end_frame bigint, start_ts double, end_ts double, family string, level string, "
         "subject_team string, opponent_team string, confidence double, quality string, calibration string, visibility string, "
         "metrics map<string, string>, limitations array<string>, conflict boolean")
EDGE = "sequence_id string, source_id string, target_id string, relation string, weight double"
CHUNK = ("text string, metadata struct<id: string, source: string, equipes: array<string>, tags_tactiques: array<string>, type_chunk: string, "
         "periode: string, intervalle_temps: string>")
TEAM_STATS = ("struct<possession_pct: int, passes_completed: int, passes_progressive: int, shots: int, shots_on_target: int, xg: double, ppda: double, "
              "bloc_style: string>")
MATCH = ("match_id string, meta struct<competition: string, saison: string, date: string, home_team: string, away_team: string, score_home: int, "
         f"score_away: int>, team_stats map<string, {TEAM_STATS}>, key_events array<struct<minute: int, team: string, type: string, description: string>>")
PLAYER_STATS = ("match_id string, player_name string, minutes_played int, goals int, expected_goals double, expected_assists double, key_passes int, "
                "progressive_dribbles int, defensive_pressures int, competition string, team_name string")
FIXTURE = ("fixture struct<id: bigint, date: string, status: struct<short: string>>, league struct<name: string, season: int>, "
           "teams struct<home: struct<name: string>, away: struct<name: string>>, goals struct<home: int, away: int>, "
           "statistics array<struct<team: struct<name: string>, statistics: array<struct<type: string, value: string>>>>, "
           "events array<struct<time: struct<elapsed: int, extra: int>, team: struct<name: string>, type: string, detail: string>>")
