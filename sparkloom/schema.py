"""Schemas of the input files and the parameters of the patterns."""

from __future__ import annotations

from dataclasses import dataclass

RECORDS = "type string, person1 string, person2 string, forum string, forum_event string, publication string, topic string, date string, lat string, lon string"
SOCIAL = "person1 long, person2 long"
CYBER = "src_device long, dst_device long, epoch_time long, duration long, protocol long, src_port long, dst_port long, src_packets long, dst_packets long, src_bytes long, dst_bytes long"
USES = "person long, server long"
COMMERCIAL = "kind string, seller string, buyer string, product string, date string, unused1 string, unused2 string, amount string"
TRIPLES = "row long, src long, rel long, dst long"

# vertex and edge kinds of the uniform graph, in the order of the feature bins
EDGE_TYPES = ("SALE", "PURCHASE", "AUTHOR", "WRITTENBY", "INCLUDES", "INCLUDEDIN", "HASTOPIC", "TOPICIN", "HASORG", "ORGIN")
VERTEX_TYPES = ("PERSON", "FORUM", "FORUMEVENT", "PUBLICATION", "TOPIC")
# trader kinds of the market graph
PRODUCER, DISTRIBUTOR, RETAILER = 3, 4, 5


@dataclass(frozen=True)
class Pattern:
    """Ids that the temporal pattern looks for; the defaults are those of the public data set."""

    bath_bomb: object = 2869238
    pressure_cooker: object = 271997
    ammunition: object = 185785
    electronics: object = 11650
    centre: object = 60
    event_topics: tuple = (771572, 179057, 127197)
    outdoor_topics: tuple = (69871376, 1049632)
    jihad: object = 44311
    engineering: object = 43035
    centre_lat: float = 40.67
    centre_lon: float = -73.94
    miles: float = 30.0
