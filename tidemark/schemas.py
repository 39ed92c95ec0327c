"""Fixed schemas of the logical tables."""

from __future__ import annotations

FILES = "file_id string, path string, length long, modified timestamp, content binary"

DISPOSITION = "struct<default: boolean, primary: boolean, forced: boolean, original: boolean, commentary: boolean, hearing_impaired: boolean, visually_impaired: boolean>"

TRACKS = f"""file_id string, track_id int, number int, type string, codec string, codec_string string, internal_codec_id string,
language string, name string, time_resolution double, disposition {DISPOSITION}, pairing array<int>, bitrate double,
duration_meta double, only_key boolean, decoder_description binary,
coded_width int, coded_height int, rotation int, channels int, sample_rate int, ordinal int"""

PACKETS = """file_id string, track_id int, seq long, type string, pts_ticks long, timestamp double, duration double,
byte_offset long, byte_length int, data binary"""

AUDIO_SAMPLES = "file_id string, track_id int, seq long, timestamp double, format string, sample_rate int, channels int, frames int, data binary"

CUES = "file_id string, ordinal int, timestamp double, duration double, text string, identifier string, settings string, notes string"

SEGMENTS = """playlist string, seq_no long, start double, duration double, unix_start double, path string, byte_offset long,
byte_length long, discontinuity int, init_path string, enc_method string, key_uri string, iv string"""

TAGS = """file_id string, title string, description string, artist string, album string, album_artist string, genre string,
lyrics string, comment string, track_no int, tracks_total int, disc_no int, discs_total int, date string, raw map<string,string>"""
