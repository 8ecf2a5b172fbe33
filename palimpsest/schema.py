"""Schemas of the engine's tables. video_id is the axis of parallelism; order is explicit in ts, frame_idx and the ordinals."""

BOX = "struct<x:double,y:double,w:double,h:double>"
QUAD = "array<struct<x:double,y:double>>"
TEXT = f"struct<text:string,score:double,box:{BOX}>"
ROI = "struct<x1:double,y1:double,x2:double,y2:double>"

VIDEOS = "video_id string, path string, fps double, total_frames bigint, width int, height int"
FRAMES = "video_id string, frame_idx bigint, ts double, width int, height int, image binary"
BOXES = f"video_id string, frame_idx bigint, ts double, box_idx int, quad {QUAD}, det_score double"
TEXTS = f"video_id string, frame_idx bigint, ts double, line_idx int, text string, score double, box {BOX}"
FRAME_TEXTS = f"video_id string, ts double, texts array<{TEXT}>"
SEGMENTS = f"video_id string, segment_id bigint, start_time double, end_time double, timestamp double, texts array<{TEXT}>"
CUES = "video_id string, idx int, start double, end double, text string"
PREDICTIONS = "sample_id bigint, head string, pred string, conf double, target string, ratio int"
