"""Cloud audit trails: {"Records": [...]} documents to resource signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import read_only

RECORD = "eventID string, eventSource string, eventName string, awsRegion string, errorCode string, requestParameters string, responseElements string"

# Service, call, what it means, the resource's type, and where its id is in the request or the answer
# (the first path that is there counts). '*' names a list: one signal for each item. Of a dependency: its type, and
# where its two ends are.
MAPPINGS = [
    ("ec2.amazonaws.com", "RunInstances", "discovered", "compute_instance", "$.responseElements.instancesSet.items[*].instanceId", ""),
    ("ec2.amazonaws.com", "TerminateInstances", "deleted", "compute_instance", "$.requestParameters.instancesSet.items[*].instanceId", ""),
    ("ec2.amazonaws.com", "CreateVolume", "discovered", "block_volume", "$.responseElements.volumeId", ""),
    ("ec2.amazonaws.com", "DeleteVolume", "deleted", "block_volume", "$.requestParameters.volumeId", ""),
    ("ec2.amazonaws.com", "AttachVolume", "dependency", "attached_volume", "$.requestParameters.instanceId", "$.requestParameters.volumeId"),
    ("ec2.amazonaws.com", "CreateVpc", "discovered", "virtual_network", "$.responseElements.vpc.vpcId", ""),
    ("ec2.amazonaws.com", "DeleteVpc", "deleted", "virtual_network", "$.requestParameters.vpcId", ""),
    ("ec2.amazonaws.com", "CreateSecurityGroup", "discovered", "firewall_rule", "$.responseElements.groupId", ""),
    ("ec2.amazonaws.com", "DeleteSecurityGroup", "deleted", "firewall_rule", "$.requestParameters.groupId", ""),
    ("ec2.amazonaws.com", "CreateSnapshot", "discovered", "backup_snapshot", "$.responseElements.snapshotId", ""),
    ("ec2.amazonaws.com", "DeleteSnapshot", "deleted", "backup_snapshot", "$.requestParameters.snapshotId", ""),
    ("rds.amazonaws.com", "CreateDBInstance", "discovered", "managed_database", "$.responseElements.dBInstanceIdentifier", "$.requestParameters.dBInstanceIdentifier"),
    ("rds.amazonaws.com", "DeleteDBInstance", "deleted", "managed_database", "$.requestParameters.dBInstanceIdentifier", ""),
    ("rds.amazonaws.com", "ModifyDBInstance", "updated", "managed_database", "$.requestParameters.dBInstanceIdentifier", ""),
    ("rds.amazonaws.com", "CreateDBCluster", "discovered", "managed_database", "$.responseElements.dBClusterIdentifier", "$.requestParameters.dBClusterIdentifier"),
    ("rds.amazonaws.com", "DeleteDBCluster", "deleted", "managed_database", "$.requestParameters.dBClusterIdentifier", ""),
    ("s3.amazonaws.com", "CreateBucket", "discovered", "object_store", "$.requestParameters.bucketName", ""),
    ("s3.amazonaws.com", "DeleteBucket", "deleted", "object_store", "$.requestParameters.bucketName", ""),
    ("lambda.amazonaws.com", "CreateFunction20150331", "discovered", "serverless_function", "$.responseElements.functionName", "$.requestParameters.functionName"),
    ("lambda.amazonaws.com", "DeleteFunction20150331", "deleted", "serverless_function", "$.requestParameters.functionName", ""),
    ("iam.amazonaws.com", "CreateRole", "discovered", "identity_role", "$.requestParameters.roleName", ""),
    ("iam.amazonaws.com", "DeleteRole", "deleted", "identity_role", "$.requestParameters.roleName", ""),
    ("iam.amazonaws.com", "CreateUser", "discovered", "identity_user", "$.requestParameters.userName", ""),
    ("iam.amazonaws.com", "DeleteUser", "deleted", "identity_user", "$.requestParameters.userName", ""),
    ("dynamodb.amazonaws.com", "CreateTable", "discovered", "managed_database", "$.requestParameters.tableName", ""),
    ("dynamodb.amazonaws.com", "DeleteTable", "deleted", "managed_database", "$.requestParameters.tableName", ""),
    ("ecs.amazonaws.com", "CreateCluster", "discovered", "container_cluster", "$.requestParameters.clusterName", ""),
    ("ecs.amazonaws.com", "DeleteCluster", "deleted", "container_cluster", "$.requestParameters.cluster", ""),
    ("ecs.amazonaws.com", "CreateService", "discovered", "container_service", "$.requestParameters.serviceName", ""),
    ("ecs.amazonaws.com", "DeleteService", "deleted", "container_service", "$.requestParameters.service", ""),
    ("eks.amazonaws.com", "CreateCluster", "discovered", "container_cluster", "$.requestParameters.name", ""),
    ("eks.amazonaws.com", "DeleteCluster", "deleted", "container_cluster", "$.requestParameters.name", ""),
    ("elasticache.amazonaws.com", "CreateCacheCluster", "discovered", "cache_cluster", "$.requestParameters.cacheClusterId", ""),
    ("elasticache.amazonaws.com", "DeleteCacheCluster", "deleted", "cache_cluster", "$.requestParameters.cacheClusterId", ""),
    ("elasticache.amazonaws.com", "CreateReplicationGroup", "discovered", "cache_cluster", "$.requestParameters.replicationGroupId", ""),
    ("elasticache.amazonaws.com", "DeleteReplicationGroup", "deleted", "cache_cluster", "$.requestParameters.replicationGroupId", ""),
    ("redshift.amazonaws.com", "CreateCluster", "discovered", "data_warehouse", "$.requestParameters.clusterIdentifier", ""),
    ("redshift.amazonaws.com", "DeleteCluster", "deleted", "data_warehouse", "$.requestParameters.clusterIdentifier", ""),
    ("sqs.amazonaws.com", "CreateQueue", "discovered", "message_queue", "$.requestParameters.queueName", ""),
    ("sqs.amazonaws.com", "DeleteQueue", "deleted", "message_queue", "$.requestParameters.queueUrl", ""),
    ("sns.amazonaws.com", "CreateTopic", "discovered", "notification_topic", "$.requestParameters.name", ""),
    ("sns.amazonaws.com", "DeleteTopic", "deleted", "notification_topic", "$.requestParameters.topicArn", ""),
    ("elasticloadbalancing.amazonaws.com", "CreateLoadBalancer", "discovered", "load_balancer", "$.requestParameters.name", "$.requestParameters.loadBalancerName"),
    ("elasticloadbalancing.amazonaws.com", "DeleteLoadBalancer", "deleted", "load_balancer", "$.requestParameters.loadBalancerArn", "$.requestParameters.loadBalancerName"),
    ("cloudfront.amazonaws.com", "CreateDistribution", "discovered", "cdn_distribution", "$.responseElements.distribution.id", ""),
    ("cloudfront.amazonaws.com", "DeleteDistribution", "deleted", "cdn_distribution", "$.requestParameters.id", ""),
    ("route53.amazonaws.com", "CreateHostedZone", "discovered", "dns_zone", "$.responseElements.hostedZone.id", ""),
    ("route53.amazonaws.com", "DeleteHostedZone", "deleted", "dns_zone", "$.requestParameters.id", ""),
    ("elasticfilesystem.amazonaws.com", "CreateFileSystem", "discovered", "file_system", "$.responseElements.fileSystemId", ""),
    ("elasticfilesystem.amazonaws.com", "DeleteFileSystem", "deleted", "file_system", "$.requestParameters.fileSystemId", ""),
    ("kinesis.amazonaws.com", "CreateStream", "discovered", "stream", "$.requestParameters.streamName", ""),
    ("kinesis.amazonaws.com", "DeleteStream", "deleted", "stream", "$.requestParameters.streamName", ""),
    ("sagemaker.amazonaws.com", "CreateEndpoint", "discovered", "ml_endpoint", "$.requestParameters.endpointName", ""),
    ("sagemaker.amazonaws.com", "DeleteEndpoint", "deleted", "ml_endpoint", "$.requestParameters.endpointName", ""),
]
DEPENDENCY_CONFIDENCE = 1.0


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, "eventSource string, eventName string, signal string, resource_type string, path string, fallback string")


def records(documents: DataFrame, column: str = "json", order: str | None = None) -> DataFrame:
    """One row for each record of each document, with ``at``: its place, by its document's (the column ``order``) and
    then in the document."""
    parsed = F.from_json(column, f"Records array<struct<{RECORD.replace(' string', ':string')}>>")
    document = F.lit(None).cast("long") if order is None else F.col(order)
    rows = documents.select(document.alias("document"), F.posexplode(parsed.getField("Records")).alias("position", "record"))
    return rows.select(F.struct("document", "position").alias("at"), "record.*")


def _paths(df: DataFrame, column: str) -> Column:
    body = F.concat(F.lit('{"requestParameters":'), F.coalesce("requestParameters", F.lit("{}")), F.lit(',"responseElements":'), F.coalesce("responseElements", F.lit("{}")), F.lit("}"))
    # get_json_object takes constant paths only, so each path of the table is one branch
    paths = sorted({m[i] for m in MAPPINGS for i in (4, 5)} - {""})
    out = F.lit(None).cast("string")
    for p in paths:
        out = F.when(F.col(column) == p, F.get_json_object(body, p)).otherwise(out)
    return out


def parse(rows: DataFrame) -> DataFrame:
    """eventID, outcome (signal, error, read_only, unrecognised, incomplete), signal, resource_type, resource_id and, of a
    dependency, target and confidence.

    Of the records with one id the first (by ``at``) counts; errors are set aside first, then reads, then what no mapping
    names."""
    record = F.struct(*(c for c in rows.columns if c not in ("eventID", "at")))
    rows = rows.groupBy("eventID").agg(F.min_by(record, "at").alias("record")).select("eventID", "record.*").join(F.broadcast(mappings(rows.sparkSession)), ["eventSource", "eventName"], "left")
    depends, other = F.coalesce(F.col("signal") == "dependency", F.lit(False)), _paths(rows, "fallback")
    found = F.when(depends, F.when(other.isNotNull(), _paths(rows, "path"))).otherwise(F.coalesce(_paths(rows, "path"), other))
    rows = rows.withColumn("target", F.when(depends, other)).withColumn("depends", depends)
    ids = F.when(F.startswith(found, F.lit("[")), F.from_json(found, "array<string>")).otherwise(F.array(F.regexp_replace(found, '^"|"$', "")))
    outcome = (
        F.when(F.col("errorCode").isNotNull(), "error").when(read_only(F.col("eventName")), "read_only").when(F.col("signal").isNull(), "unrecognised")
        .when(found.isNull(), "incomplete").otherwise("signal")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("ids", F.when(F.col("outcome") == "signal", ids).otherwise(F.array(F.lit(None).cast("string"))))
    is_signal = F.col("outcome") == "signal"
    return rows.select("eventID", "outcome", F.when(is_signal, F.col("signal")).alias("signal"), F.when(is_signal, F.col("resource_type")).alias("resource_type"), F.explode("ids").alias("resource_id"), F.when(is_signal, F.col("target")).alias("target"), F.when(is_signal & F.col("depends"), DEPENDENCY_CONFIDENCE).alias("confidence"))
