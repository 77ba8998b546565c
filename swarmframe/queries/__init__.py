"""Every operator as a query over the test tables, with its SQL counterpart."""

from swarmframe.queries.access_queries import QUERIES as _access
from swarmframe.queries.dataset_queries import QUERIES as _dataset
from swarmframe.queries.detection_queries import QUERIES as _detections
from swarmframe.queries.packet_queries import QUERIES as _packets
from swarmframe.queries.stream_queries import QUERIES as _streams
from swarmframe.queries.sync_queries import QUERIES as _sync

ALL = {**_sync, **_packets, **_dataset, **_detections, **_access, **_streams}
